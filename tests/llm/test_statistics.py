"""Source divergence, ranked search and the quality model against brute force, and their defined cases."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqlake.llm import divergence, quality_gam, ranked_search
from seqlake.llm.terms import LETTERS, LETTERS_DIGITS, terms

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns that the operators use as names of their own.
CLASH = DOC + ", n string, term string, item string, block string, tile string, score string, value string, rank string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = "the The THE of naïve Éa éa x1 a-b c3po Straße ЖУК 漢字 don't zz yy xx ww vv uu".split()


def docs(spark, rows):
    return spark.createDataFrame([(*row, None, *["x"] * 8) for row in rows], CLASH)


def letters(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def letters_digits(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_terms_equal_the_patterns():
    rng = random.Random(3)
    texts = ["".join(rng.choice("aZ09 _-\n\t@[`{é\x00\x7fЖ漢") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "A" * 3000]
    for table, plain in ((LETTERS, letters), (LETTERS_DIGITS, letters_digits)):
        whole = pa.array(texts, pa.string())
        for batch in (whole, whole.slice(50, 70), whole.cast(pa.large_string()), whole.slice(201)):
            flat, sizes = terms(batch, table)
            want = [plain(text) for text in batch.to_pylist()]
            assert sizes.tolist() == [len(found) for found in want]
            assert flat.to_pylist() == [term for found in want for term in found]


def brute_audit(rows, min_docs=3, top=200):
    groups, counts, in_docs = set(), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(letters(text))
        in_docs[lang].update(set(letters(text)))
    out = []
    for lang, source in groups:
        kept = [term for term, n in in_docs[lang].items() if n >= min_docs]
        share = lambda count, total: 1 + int(Fraction(10**9 * (count + 1), total + len(kept)))
        own = lambda s: sum(counts[lang, s][t] for t in kept)
        p = {t: share(counts[lang, source][t], own(source)) for t in kept}
        ranked = []
        for other in sorted({s for g, s in groups if g == lang and s != source}):
            q = {t: share(counts[lang, other][t], own(other)) for t in kept}
            ranked.append((other, sum((p[t] - q[t]) ** 2 // q[t] for t in kept)))
        out += [(lang, source, "pair", item, value, n + 1) for n, (item, value) in enumerate(sorted(ranked, key=lambda r: (-r[1], r[0].encode())))]
        sources = [s for g, s in groups if g == lang]
        held = sum(own(s) for s in sources)
        telling = []
        for t in kept:
            q = share(sum(counts[lang, s][t] for s in sources), held)
            if counts[lang, source][t] and p[t] > q:
                telling.append((t, (p[t] - q) ** 2 // q))
        telling.sort(key=lambda r: (-r[1], r[0].encode()))
        out += [(lang, source, "term", item, value, n + 1) for n, (item, value) in enumerate(telling[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def sourced():
    """A hot source, many small ones, rows without text, lang or source, repeated rows, a lang with no kept term."""
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choices(WORDS, weights=range(len(WORDS), 0, -1), k=n))
    rows = [(n, text(rng.randrange(0, 25)), rng.choice(["en", "fr", None]), rng.choice(["hot"] * 4 + [f"s{i}" for i in range(7)] + [None, "Ä"])) for n in range(120)]
    rows += [(500, None, "en", "silent"), (501, "", "en", "silent"), (502, "rare words here", "de", "a"), (503, "other", "de", "b")]
    rows += [(504, "alone " * 5, "it", "one")] * 4 + [(None, "the naïve x", None, None), (None, None, None, None)]
    return rows


@pytest.mark.parametrize("cut", [{}, {"tile": 3, "block": 4}, {"tile": 1, "block": 1}, {"group_bytes": 0, "top_terms": 2}])
def test_divergence_equals_brute_force(spark, sourced, cut):
    got = sorted(map(tuple, divergence.audit(docs(spark, sourced), **cut).collect()))
    assert got == brute_audit(sourced, top=cut.get("top_terms", 200))


def test_divergence_cases(spark):
    none = divergence.audit(docs(spark, []))
    assert none.columns == ["lang", "source", "part", "item", "value", "rank"] and none.count() == 0
    # Values near the limit of 64 bits: a common term against one that is missing.
    rows = [(n, "big " * 200_000 if n == 0 else "big odd", "en", f"s{n % 2}") for n in range(6)]
    assert sorted(map(tuple, divergence.audit(docs(spark, rows)).collect())) == brute_audit(rows)


def test_divergence_share_is_exact(spark):
    cases = [(0, 1), (0, 10**15), (10**15 - 1, 10**15), (6, 7), (123_456_789_012, 987_654_321_098), (10**10, 3 * 10**12 + 1)]
    frame = spark.createDataFrame(cases, "n bigint, total bigint").select("n", "total", divergence.share("n", "total").alias("p"))
    assert {(r.n, r.total): r.p for r in frame.collect()} == {(n, total): 1 + 10**9 * (n + 1) // total for n, total in cases}


def brute_search(rows, items, k=50):
    held = [(doc, Counter(letters_digits(text))) for doc, text, *_ in rows]
    n_docs, n_terms = sum(1 for _, c in held if c), sum(c.total() for _, c in held)
    df = Counter(term for _, c in held for term in c)
    wanted = defaultdict(set)
    for item, text in items:
        wanted[item] |= set(letters_digits(text))
    out = Counter()
    for item, terms_of in wanted.items():
        scores = []
        for doc, c in held:
            total = 0
            for t in terms_of:
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    total += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (50 + 50 * c.total() * n_docs // n_terms)))
            if total > 0:
                scores.append((total, doc))
        scores.sort(key=lambda s: (-s[0], s[1] is not None, s[1]))
        out.update((item, rank + 1, doc, score) for rank, (score, doc) in enumerate(scores[:k]))
    return out


@pytest.mark.parametrize("cut", [{}, {"k": 3, "width": 2}, {"k": 7, "tile_bytes": 1500}])
def test_ranked_search_equals_brute_force(spark, cut):
    rng = random.Random(4)
    text = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(9)}" for _ in range(n))
    rows = [(n, text(rng.randrange(0, 40)), None, None) for n in range(150)]
    # Ties beyond k, copies, repeated rows, rows without id or text.
    rows += [(200 - n, rows[1][1], None, None) for n in range(40)] + [(7, "the1 x11", None, None)] * 3
    rows += [(None, rows[1][1], None, None), (None, None, None, None), (300, "", None, None)]
    items = [(n, text(rng.randrange(1, 12))) for n in range(30)] + [(3, "extra the1"), (3, None), (90, None), (91, ""), (92, "unheard of"), (None, "the1 of2")]
    frame = spark.createDataFrame([(*item, "x", "x") for item in items], "item_id bigint, text string, rank string, doc_id string")
    got = Counter(map(tuple, ranked_search.top_documents(docs(spark, rows), frame, **cut).collect()))
    assert got == brute_search(rows, items, cut.get("k", 50))


def test_ranked_search_cases(spark):
    items = spark.createDataFrame([(1, "the"), (2, "of")], "item_id bigint, text string")
    some = docs(spark, [(1, "the of", None, None)])
    for corpus, wanted in ((docs(spark, []), items), (some, items.limit(0)), (docs(spark, [(1, None, None, None)]), items)):
        found = ranked_search.top_documents(corpus, wanted)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_ranked_search_width_keeps_products_exact():
    weights = np.array([30_000], np.int64)
    assert ranked_search.exact_width(weights) == ranked_search.WIDTH
    huge = np.array([10**8], np.int64)
    width = ranked_search.exact_width(huge)
    assert width * 10**8 * 10**6 < 2**53 <= (width + 1) * 10**8 * 10**6


def plain_features(text):
    text = text or ""
    data, out = text.encode(), {}
    count = lambda test: sum(1 for byte in data if test(byte))
    chars = max(1, len(text))
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = text.split("\n")
    share = lambda n, of: n / max(1, of)
    out["log_bytes"], out["log_words"] = math.log1p(len(data)), math.log1p(len(words))
    out["upper"] = count(lambda b: 65 <= b <= 90) / chars
    out["lower"] = count(lambda b: 97 <= b <= 122) / chars
    out["digit"] = count(lambda b: 48 <= b <= 57) / chars
    out["blank"] = count(lambda b: b in b" \t") / chars
    out["stop"] = count(lambda b: b in b".,;:?") / chars
    out["quote"] = count(lambda b: b in b"'\"()-") / chars
    ascii_marks = {b for b in range(128) if not chr(b).isalnum() and b not in b" \t\n\r\x0b\x0c.,;:?'\"()-"}
    out["mark"] = count(lambda b: b in ascii_marks) / chars
    out["wide"] = count(lambda b: b >= 0xC0) / chars
    out["word_length"] = share(sum(map(len, words)), len(words))
    out["longest_word"] = math.log1p(max(map(len, words), default=0))
    out["with_letter"] = share(sum(any(c.isalpha() for c in w) for w in words), len(words))
    out["capital_word"] = share(sum(w[0].isupper() for w in words), len(words))
    shouted = lambda w: sum(c.isupper() for c in w) > 1 and not any(c.isalpha() and not c.isupper() for c in w)
    out["shouted_word"] = share(sum(map(shouted, words)), len(words))
    marked = lambda w: any(not c.isalpha() and not c.isnumeric() and c not in ".,;:?!'\"()-" for c in w)
    out["marked_word"] = share(sum(map(marked, words)), len(words))
    out["ended_word"] = share(sum(w[-1] in ".!?" for w in words), len(words))
    out["different_words"] = share(len(set(words)), len(words))
    out["repeated_next"] = share(sum(a == b for a, b in itertools.pairwise(words)), len(words))
    out["commonest_word"] = share(max(Counter(words).values(), default=0), len(words))
    out["line_words"] = math.log1p(len(words) / len(lines))
    out["different_lines"] = len(set(lines)) / len(lines)
    out["longest_line"] = math.log1p(max(map(len, lines)))
    return [out[name] for name in quality_gam.FEATURES]


TEXTS = [
    None, "", " \n ", "a", "The naïve Straße, isn't it? 42!", "AB CD!! AB CD!!\nAB CD!! x\tY\n\n", "to to to be|be *** $$$", "漢字 ЖУК жук 7½ €5",
    "same line\nsame line\nother", "word " * 3000,
]


def test_quality_features_equal_plain_loops():
    whole = pa.array(["left out", *TEXTS], pa.string())
    for batch in (whole.slice(1), whole.slice(1).cast(pa.large_string())):
        np.testing.assert_allclose(quality_gam.features(batch), [plain_features(text) for text in TEXTS], rtol=1e-12)
    assert quality_gam.features(pa.array([], pa.string())).shape == (0, len(quality_gam.FEATURES))


def test_quality_score_adds_the_tables():
    rng = np.random.default_rng(1)
    values = rng.normal(size=(400, 4))
    # Neither feature alone tells anything of the label: it takes the pair.
    label = ((values[:, 0] > 0) ^ (values[:, 1] > 0)).astype(int)
    model = quality_gam.fit(values, label)
    assert (0, 1) in model.pairs
    got = model.scores(values)
    for row, score in zip(values[:50], got):
        total = model.bias + sum(table[sum(edge <= v for edge in edges)] for v, edges, table in zip(row, model.edges, model.tables))
        for (a, b), table in zip(model.pairs, model.pair_tables):
            total += table[sum(e <= row[a] for e in model.pair_edges[a]), sum(e <= row[b] for e in model.pair_edges[b])]
        assert score == pytest.approx(1 / (1 + math.exp(-total)))
    assert ((got >= 0.5) == label).mean() > 0.95


def test_quality_trees_cut_where_the_gain_is_largest():
    gradient, hessian = np.array([-4.0, -5, 3, 4, 20, 21]), np.full(6, 5.0)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)
    best = max(range(1, 6), key=lambda p: gain(gradient[:p], hessian[:p]) + gain(gradient[p:], hessian[p:]))
    tree = quality_gam.line_tree(gradient, hessian, depth=1)
    assert best == 4 and np.allclose(tree, [*[-2 / 21] * 4, *[41 / 11] * 2])
    # A step over two features: the sign changes with both.
    grid = np.array([[9.0, -9], [-9, 9]])
    steps, found = quality_gam.pair_tree(grid, np.full((2, 2), 5.0))
    assert np.allclose(steps, grid / 6) and found == pytest.approx(4 * 81 / 6)


def made_quality(rng, good):
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 8))) for _ in range(rng.randrange(5, 80))]
    if good:
        return " ".join(words).capitalize() + "."
    kind = rng.randrange(3)
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    return " | ".join(words) if kind == 1 else " ".join(w for w in words[:9] for _ in range(12))


def test_quality_model_on_held_out_rows_and_its_cases(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for n in range(900):
        good = rng.random() < 0.8
        rows.append((n, made_quality(rng, good), None, None))
        marks.append((n, int(good), "x"))
    rows += [(2000, None, None, None), (2001, "", None, None), (None, "Who are you?", None, None), (5, rows[5][1], None, None)]
    marks += [(None, 1, "x"), (3, None, "x"), (99_999, 0, "x")]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, text string")
    frame = docs(spark, rows)
    model = quality_gam.train(frame, labels)
    scored = quality_gam.score(frame, model)
    assert scored.columns == ["doc_id", "held_out", "score", "predicted"]
    got = scored.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = {n: mark for n, mark, _ in marks}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    assert not any(r.held_out for r in got if r.doc_id is None)
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add(r.score)
    assert len(by_id[5]) == 1 and by_id[2000] == by_id[2001]
    assert quality_gam.score(docs(spark, []), model).count() == 0
    # Labels of the held-out fold change nothing.
    flipped = labels.withColumn("quality", F.expr("if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality)"))
    again = quality_gam.train(frame, flipped)
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    # Without labels, and with one label only.
    none = quality_gam.score(frame, quality_gam.train(frame, labels.limit(0))).collect()
    assert {r.predicted for r in none} == {1}
    bad = quality_gam.score(frame, quality_gam.train(frame, labels.filter("quality = 0"))).collect()
    assert {r.predicted for r in bad} == {0}


def test_a_very_long_text(spark):
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(20_000)}" for _ in range(800_000))
    rows = [(1, text, "en", "a"), (2, "w1 w2 w3", "en", "b"), (3, "w " * 5, "en", "b")]
    frame = docs(spark, rows)
    assert sorted(map(tuple, divergence.audit(frame).collect())) == brute_audit(rows)
    items = [(1, "w1 w2 w3"), (2, text)]
    wanted = spark.createDataFrame(items, "item_id bigint, text string")
    assert Counter(map(tuple, ranked_search.top_documents(frame, wanted).collect())) == brute_search(rows, items)
    np.testing.assert_allclose(quality_gam.features(pa.array([text])), [plain_features(text)], rtol=1e-9)
