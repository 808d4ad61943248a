"""Operators whose work is in Python functions: against brute force, without Spark."""

import itertools
import math
import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from lodestone.llm import chat, decontaminate, html_extract, langid, minhash, pitman_yor, quality, toxicity, warc
from lodestone.llm.text import Vocabulary, windows, words_of


def test_words_are_the_contracts_words():
    for text in ("A b\tC\x0bd\x0ce\r\nf", "", None, "x\x1cy\x85z\xa0w é", " \n"):
        want = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        assert [w.decode() for w in words_of(text)] == want


def counts_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if triples[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def test_quality_counts():
    rng = random.Random(1)
    texts = [None, "", " \n ", "a a a", "a a a a", "é|ü # x", "l\nl\nl \nl", "x " * 60]
    texts += [" ".join(rng.choice(["a", "b", "cé", "d*", "\n"]) for _ in range(rng.randrange(120))) for _ in range(60)]
    for t in texts:
        assert quality.judge(t)[:6] == counts_by_hand(t), t


def test_quality_posterior_separates_kinds_of_bad():
    good, symbols, repeats = "++++++++", "-+++++-+", "+----++-"
    post = quality.fit({good: 900, symbols: 40, repeats: 60, "+0++++++": 80})
    assert post[good] > 0.9 and post["+0++++++"] > 0.9 and post[symbols] < 0.1 and post[repeats] < 0.1
    assert quality.fit({}) == {}


def test_quality_fit_against_plain_expectation_maximisation():
    patterns = {"++++++++": 500, "+-++++++": 60, "-+++++-+": 40, "+----++-": 30, "0+++++0+": 5}
    classes = [quality.GOOD] + [quality.OTHER] * len(quality.GROUPS)
    p = [[dict(zip("+0-", quality.OWN if c and quality.RULES[r] in quality.GROUPS[c - 1] else classes[c], strict=True)) for r in range(8)] for c in range(len(classes))]
    belief = [[dict(x) for x in row] for row in p]
    prior, total = [0.8] + [0.2 / (len(p) - 1)] * (len(p) - 1), sum(patterns.values())
    for _ in range(300):
        post = {}
        for v in patterns:
            joint = [prior[c] * math.prod(p[c][r][o] for r, o in enumerate(v)) for c in range(len(p))]
            post[v] = [j / sum(joint) for j in joint]
        for c in range(len(p)):
            for r in range(8):
                n = {o: sum(patterns[v] * post[v][c] for v in patterns if v[r] == o) + quality.PRIOR_SHARE * total * belief[c][r][o] for o in "+0-"}
                p[c][r] = {o: x / sum(n.values()) for o, x in n.items()}
            prior[c] = (sum(patterns[v] * post[v][c] for v in patterns) + 1e-3 * total) / (total * (1 + 1e-3 * len(p)))
    got = quality.fit(patterns)
    assert all(math.isclose(got[v], post[v][0], abs_tol=1e-9) for v in patterns)
    assert got["+-++++++"] > 0.9 and got["-+++++-+"] < 0.1


def enumerated(emission, trans):
    """Marginals of one chain over all tag sequences."""
    n, total, top = len(emission), 0.0, np.zeros(len(emission))
    for tags in itertools.product((0, 1), repeat=n):
        s = sum(e for e, y in zip(emission, tags, strict=True) if y) + sum(trans[a, b] for a, b in itertools.pairwise(tags))
        w = math.exp(s)
        total += w
        top += w * np.array(tags)
    return top / total, math.log(total)


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    lengths, trans = [5, 1, 7, 3], rng.normal(size=(2, 2))
    emission = rng.normal(size=sum(lengths))
    starts = np.zeros(len(emission), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    p, _, logz = toxicity.marginals(emission, starts, trans)
    parts = [enumerated(e, trans) for e in np.split(emission, np.cumsum(lengths)[:-1])]
    assert np.allclose(p, np.concatenate([x for x, _ in parts])) and math.isclose(logz, sum(z for _, z in parts))


def test_long_chains_are_not_cut():
    rng = np.random.default_rng(3)
    lengths, trans = [700, 1, 64, 65, 128, 3, 200], rng.normal(size=(2, 2))
    emission = rng.normal(size=sum(lengths)) * 2
    starts = np.zeros(len(emission), bool)
    starts[np.cumsum([0, *lengths[:-1]])] = True
    p, pairs, logz = toxicity.marginals(emission, starts, trans)
    m, want, all_pairs, total = np.exp(trans), [], np.zeros((2, 2)), 0.0
    for e in np.split(emission, np.cumsum(lengths)[:-1]):
        f, b = np.zeros((len(e), 2)), np.ones((len(e), 2))
        w = np.stack([np.ones(len(e)), np.exp(e)], 1)
        f[0] = w[0]
        for i in range(1, len(e)):
            total += math.log(f[i - 1].sum())
            f[i - 1] /= f[i - 1].sum()
            f[i] = f[i - 1] @ m * w[i]
        total += math.log(f[-1].sum())
        for i in range(len(e) - 1, 0, -1):
            b[i - 1] = m @ (b[i] * w[i])
            b[i - 1] /= b[i - 1].sum()
            joint = f[i - 1][:, None] * m * (b[i] * w[i])[None, :]
            all_pairs += joint / joint.sum()
        post = f * b
        want.append(post[:, 1] / post.sum(1))
    assert np.allclose(p, np.concatenate(want)) and np.allclose(pairs, all_pairs) and math.isclose(logz, total)


def test_toxicity_learns_words_and_prefixes():
    rng = random.Random(4)
    plain = [f"w{rng.randrange(300)}" for _ in range(4000)]
    rows = []
    for k in range(300):
        words = rng.sample(plain, 40)
        if k % 5 == 0:
            for _ in range(3):
                words[rng.randrange(40)] = rng.choice(["Idiot,", "vexor" + rng.choice("abcdef") + rng.choice("xyz")])
        rows.append((" ".join(words) + ".", int(k % 5 == 0)))
    model = toxicity.train(rows)
    texts = ["w1 w2 idiot w3.", "w1 vexorqq w2", "w1 w2 w3", "", "   "]
    p = model.chances([toxicity.TOKEN.findall(t) for t in texts])
    scores = [model.score(x) for x in p]
    assert scores[0] > 0.5 and scores[1] > 0.5 and max(scores[2:]) < 0.5 and list(np.flatnonzero(p[0] > 0.5)) == [2]
    assert toxicity.train([]).fallback == 0.0 and toxicity.train([("a", 1)]).fallback == 1.0


def test_toxicity_training_holds_little():
    rng = random.Random(9)
    plain = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(20_000)]
    rows = [(" ".join(rng.choices(plain, k=999) + ["scum."] * (k % 4 == 0)), int(k % 4 == 0)) for k in range(200)]
    toxicity.train(rows[:8], epochs=1)
    tracemalloc.start()
    try:
        model = toxicity.train(rows, epochs=4)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert model.fallback is None and most < 24e6  # 20,000 distinct ones of 200,000 tokens


def test_toxicity_trains_in_blocks(monkeypatch):
    rng = random.Random(10)
    rows = [(" ".join(rng.choice("abcdef") * 4 + rng.choice(["", "", "."]) for _ in range(60)) + " scum" * (k % 3 == 0), int(k % 3 == 0)) for k in range(60)]
    whole = toxicity.train(rows)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    parts = toxicity.train(rows)
    assert whole.fallback is None and np.allclose(whole.weights, parts.weights) and np.allclose(whole.trans, parts.trans) and np.allclose(whole.link, parts.link)
    used, at = toxicity.numbered(np.array([5, 2, 5, 9, 2] * 30, np.int32), 11)
    assert used.tolist() == [5, 2, 9] and at.tolist() == [0, 1, 0, 2, 1] * 30


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""),
        ("", ""),
        (page("<nav>menu</nav><article><h1>H &amp; x</h1><p>a\n b<p>c&nbsp;d<br>e</article><footer>f</footer>"), "H & x a b c d e"),
        (page("<article><p>a<script>var t='</p>';</script>b</p><aside>no</aside></article>"), "ab"),
        (page("<div class='ad'>no</div><div id=main><p>yes</p></div><form>no</form>"), "yes"),
        (page("<article><p>x</p><div class='comments'><p>no</p></div></article><p>out"), "x"),
        ("plain 1 < 2 text", "plain 1 < 2 text"),
        ("<p>a<!-- no --><p>b &lt;tag&gt; &#233;", "a b <tag> é"),
        ("<article><p>cut off <b", "cut off"),
        (page("<article><p hidden>no</p><ul><li>one<li>two</ul></article>"), "one two"),
        ('<div style="overflow:hidden"><p>real text', "real text"),
        ('<p title="the hidden valley">a<p data-hidden="false">b<div data-id="ad">c</div>', "a b c"),
        ('<p><a href="/search?id=ad">link words</a> on', "link words on"),
        ('<p>keep <span class="share">no<br>no</span> more', "keep more"),
        ("<p>keep <span hidden>no<br></span> more", "keep more"),
        (page("<main><h1>Title</h1><p>long text</p><article class=card>quoted</article></main><article>out"), "Title long text quoted out"),
        (page("<div class='no-sidebar'><main><p>yes</p></main></div>"), "yes"),
        ("<div>" * 3000 + "deep" + "</p></div>" * 5000 + " <p>x", "deep x"),
    ],
)
def test_html(source, want):
    assert next(html_extract.extract_iter([source])) == want


def test_parsing_is_linear():
    began = time.process_time()
    for source in ("<div>x" * 30_000, "<div>x" * 15_000 + "</div>" * 40_000, "<p>x<b>" * 30_000, "</i>x" * 100_000, "<a " + "x='y' " * 100_000 + ">z", "<a x='" * 50_000, "<ul><li>" * 15_000):
        html_extract.Page(source).hashes()
    assert time.process_time() - began < 60


def sw(a, b):
    best, h = 0.0, [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
        best = max(best, h[i][j])
    return best


def test_alignment_against_plain_dynamic_programming():
    rng = np.random.default_rng(5)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 15))
        score, x, y = decontaminate.align(a, b)
        assert math.isclose(score, sw(list(a), list(b))) and math.isclose(sw(list(a), list(b[x:y])), score)


def test_leaks_exact_edited_and_absent():
    rng = random.Random(6)
    item = [f"t{rng.randrange(500)}".encode() for _ in range(40)]
    noise = lambda n: [f"n{rng.randrange(500)}".encode() for _ in range(n)]
    edited = [noise(1)[0] if k % 6 == 2 else w for k, w in enumerate(item)]
    shorter = [w for k, w in enumerate(item) if k % 9]
    index = decontaminate.Index([(7, item), (8, [b"a", b"b"])], {}, 10_000)
    vocabulary = Vocabulary()
    for words, found in ((noise(30) + item + noise(9), True), (noise(9) + edited, True), (shorter + noise(500), True), (noise(300), False), (item[:8] + noise(20), False), ([], False)):
        hits = index.find(vocabulary.hashed(words))
        assert bool(hits) == found
        assert all(h[0] == 7 and 0 <= h[2] < h[3] <= len(words) for h in hits)


def test_leaks_of_short_items_of_common_words():
    words = [b"of", b"the", b"and", b"to", b"in", b"that", b"it"]
    counts = dict.fromkeys(words, 50_000_000)
    noise = [b"n%d" % k for k in range(20)]
    vocabulary = Vocabulary()
    for m in (5, 6, 7):
        index = decontaminate.Index([(1, words[:m])], counts, 5_000_000_000)
        assert [h[:2] for h in index.find(vocabulary.hashed(noise + words[:m] + noise))] == [(1, 1.0)]
    # A long item of which only the end is there.
    item = [b"x%d" % k for k in range(5)] + words
    index = decontaminate.Index([(1, item)], counts | dict.fromkeys(item[:5], 50_000_000), 5_000_000_000)
    assert index.find(vocabulary.hashed(noise + words + noise))


def test_repeated_seeds_cost_the_text_once():
    words = [b"a"] * 200
    index = decontaminate.Index([(1, words), (2, [b"a", b"b"] * 50)], {b"a": 10**6, b"b": 10**6}, 10**7)
    vocabulary, began = Vocabulary(), time.process_time()
    assert index.find(vocabulary.hashed([b"a"] * 40_000))[0][:2] == (1, 1.0)
    assert [h[0] for h in index.find(vocabulary.hashed([b"a", b"b"] * 20_000))] == [2]
    assert time.process_time() - began < 20


def test_template_language():
    render = chat.compile_template("{% set x = 'a' ~ (1 + 2) %}{% for m in messages %}{% if not m.role == 'user' and m['text'] != 'z' %}<{{ m.text }}>{% elif m.role in 'user' %}u{% else %}-{% endif %}{% endfor %}{{ x }}")
    assert render([{"role": "user", "text": "q"}, {"role": "bot", "text": "r"}, {"role": "bot", "text": "z"}]) == ("u<r>-a3", [])
    folded = chat.fold(chat.Parser("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}").template(), {})
    assert folded == [chat.Print(chat.Const("abcd"))]
    for bad in ("{% for x %}{% endfor %}", "{% if a %}", "{{ a( }}", "{{ a | nope }}", "{{ }}", "{{ 'a' + 1 }}", "{% exec x %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert chat.compile_template("{{ messages.__class__ }}{{ m.__init__ }}")([])[0] == ""


def test_template_knows_the_place_in_a_conversation():
    source = "{% for m in messages %}{% if loop.first %}^{% endif %}{{ loop.index }}{{ m.text }}{% if loop.previtem.role == m.role %}+{% endif %}{% if loop.last %}${% endif %}{% endfor %}"
    render, turns = chat.compile_template(source), [{"role": r, "text": t} for r, t in (("u", "a"), ("u", "b"), ("s", "c"))]
    whole = render(turns)[0]
    assert whole == "^1a2b+3c$"
    parts = [render([t], k, turns[k - 1] if k else None, k == 2)[0] for k, t in enumerate(turns)]
    assert "".join(parts) == whole and render([])[0] == ""


def test_chat_round_trip():
    rng = random.Random(8)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "\\", "\n", "<", "é", "", "x", "\x00", "</s>[INST] ok [/INST]"]
    render = chat.compile_template()
    for _ in range(200):
        turns = [(rng.choice(["user", "assistant", "system", "tool\nx", ""]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(5))]
        text, spans = render([{"role": r, "text": t} for r, t in turns])
        assert list(chat.parse(text)) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_network_learns_and_names_letterless_texts():
    rng = random.Random(9)
    make = lambda s: " ".join("".join(rng.choice(s) for _ in range(5)) for _ in range(60))
    net = langid.train([(make("abcd"), "xx") for _ in range(40)] + [(make("bcdé"), "yy") for _ in range(40)])
    got = net.predict([make("abcd"), make("bcdé"), None, "", "12 !!", make("bcdé") * 20])
    assert [g[0] for g in got] == ["xx", "yy", "und", "und", "und", "yy"] and all(0 <= g[1] <= 1 for g in got)
    assert langid.train([]).predict(["abc"]) == [("und", 0.0)]


def test_minhash_parts():
    v = Vocabulary()
    a = minhash.shingles(words_of("a b c d e f"), v)
    assert len(a) == 2 and len(minhash.shingles(words_of("a b"), v)) == 1 and len(minhash.shingles([], v)) == 0
    assert minhash.fingerprint(a) == minhash.fingerprint(minhash.shingles(words_of("A B c d E f"), v))
    long = np.unique(windows(v.hashed([b"%d" % i for i in range(2000)]), 5))
    f = minhash.permutations(20)
    assert (minhash.minima(long, f) == (long[:, None] * f[None, :]).min(0)).all()


def test_warc_records_and_ranges(tmp_path):
    pages = [(1, "http://a/%\n", "<p>x</p>".encode()), (None, None, b""), (3, "u", b"\x1f\x8b\x08" * 50 + bytes(range(256)))]
    data, offsets = b"", []
    for p, u, x in pages:
        offsets.append(len(data))
        data += warc.record(p, u, x, "response", None)
    offsets.append(len(data))
    data += warc.record(4, "u", b"abc", "revisit", 9)
    path = tmp_path / "x.warc.gz"
    path.write_bytes(data)
    for step in (1, 7, 100, len(data)):
        got = [r for a in range(0, len(data), step) for r in warc.scan(f"file://{path}", a, a + step)]
        assert [g[0] for g in got] == offsets
    assert got[0][1]["x-page-id"] == "1" and warc.unline(got[0][1]["warc-target-uri"]) == pages[0][1]
    assert got[2][2].partition(b"\r\n\r\n")[2].removesuffix(b"\r\n\r\n") == pages[2][2] and got[3][1]["x-refers-to-page"] == "9"


def model_logs(texts, learn):
    """The bucket of one block, and log10 of every token, through the same steps as in Spark."""
    b = pitman_yor.Bucket(pitman_yor.send(0, texts, np.array(learn), 1))
    kept = pitman_yor.sample(b, 0)
    answer = pitman_yor.answer(b, kept, pitman_yor.tables_offered(b, kept)[1], 0)
    hashes, place, context, lengths = pitman_yor.layout(texts)
    logs = pitman_yor.told_logs(answer["logs"].tolist())
    return b, logs[pitman_yor.cells_of(hashes, place, context, 1)[2]], np.cumsum(lengths) - lengths


def test_predictive_probabilities_sum_to_one():
    rng = random.Random(10)
    vocabulary = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, range(1, 31), k=40)) for _ in range(50)]
    # Every context meets every token, the unknown one included, in texts that don't teach.
    probe = [f"{p} {w}" for p in vocabulary for w in [*vocabulary, "unseen"]] + vocabulary
    _, logs, at = model_logs(texts + probe, [True] * len(texts) + [False] * len(probe))
    sums = Counter()
    for text, i in list(zip(texts + probe, at, strict=True))[len(texts) :]:
        # The second token: a word, or the end for one-word texts.
        sums[text.split()[0]] += 10.0 ** logs[i + 1]
    assert len(sums) == 30 and all(abs(x - 1) < 1e-4 for x in sums.values())


def test_words_are_contexts_of_their_own():
    pairs = [(f"{i}same", f"next{i}") for i in range(100)]
    texts = [f"{a} {b}" for a, b in pairs] * 3
    probe = [f"{a} {pairs[(i + k) % 100][1]}" for k in (0, 1) for i, (a, _) in enumerate(pairs)]
    _, logs, at = model_logs(texts + probe, [True] * len(texts) + [False] * len(probe))
    second = logs[at[len(texts) :] + 1]
    assert second[:100].min() > math.log10(0.3) and second[100:].max() < math.log10(0.1)


def interpolated_bigram(train, test):
    """log10 a token of a Witten-Bell bigram over a Witten-Bell unigram over V + 1 tokens."""
    one, two, after = Counter(), Counter(), Counter()
    for words in train:
        for a, b in zip(["", *words], [*words, ""], strict=True):
            one[b] += 1
            after[a] += two[a, b] == 0
            two[a, b] += 1
    total, v = sum(one.values()), len(one)
    seen = Counter()
    for (a, _), n in two.items():
        seen[a] += n
    out = n = 0
    for words in test:
        for a, b in zip(["", *words], [*words, ""], strict=True):
            p = (one[b] + v / (v + 1)) / (total + v)
            if seen[a]:
                p = (two[a, b] + after[a] * p) / (seen[a] + after[a])
            out, n = out + math.log10(p), n + 1
    return out / n


def test_held_out_text_is_told_better_than_by_an_interpolated_bigram():
    rng = random.Random(13)
    vocabulary = [f"w{int(1.4 ** (i / 12))}x{i}" for i in range(600)]
    follow = {w: rng.sample(vocabulary, 12) for w in vocabulary}

    def text():
        words = [rng.choice(vocabulary)]
        for _ in range(rng.randrange(20, 60)):
            words.append(follow[words[-1]][min(11, int(rng.expovariate(0.4)))] if rng.random() < 0.8 else rng.choices(vocabulary, range(600, 0, -1))[0])
        return words

    train, test = [text() for _ in range(300)], [text() for _ in range(80)]
    _, logs, at = model_logs([" ".join(t) for t in train + test], [True] * 300 + [False] * 80)
    held = logs[at[300] :]
    assert held.mean() > interpolated_bigram(train, test)


def test_tables_follow_their_conditional_distribution():
    rng, d = np.random.default_rng(12), 0.8
    numbers = pitman_yor.stirling(d)
    for c, pull in ((2, 0.01), (3, 0.5), (60, 5.0), (700, 40.0), (2000, 20.0), (5000, 3.0)):
        logs = np.full(c + 2, -np.inf)
        logs[1] = 0.0
        for n in range(1, c):
            grown = np.full(c + 2, -np.inf)
            grown[1 : n + 1] = logs[1 : n + 1] + np.log(n - d * np.arange(1, n + 1))
            grown[1:] = np.logaddexp(grown[1:], logs[:-1])
            logs = grown
        t = np.arange(c + 2)
        p = np.exp((x := logs + t * math.log(pull)) - x.max())
        got = pitman_yor.drawn(np.full(20_000, c), np.full(20_000, pull), d, numbers, rng)
        mean = (t * p).sum() / p.sum()
        assert abs(got.mean() / mean - 1) < 0.02
        assert abs(got.var() - ((t - mean) ** 2 * p).sum() / p.sum()) < 0.05 * got.var() + 1e-3
