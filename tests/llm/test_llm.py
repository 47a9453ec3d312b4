"""Each operator against a brute-force version on a small table with nulls, empty and long texts, ties and repeats."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
import xxhash  # noqa: E402

import oracle  # noqa: E402
from evidra.llm import bpe, embedding_dedup, html_text, imatch, ngram_join, packing, quality, queries, substring_dedup, token_counts, warc  # noqa: E402
from evidra.llm.graph import components  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, batch long, n string, key string"


def texts() -> list[tuple[int, str | None]]:
    rng = random.Random(3)
    words = ["the", "Of", "data", "é", "中文", "x9", "a,", "b!", "end.", "don't", "<|endoftext|>", "1234"]
    say = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    base, part = say(120), say(30)
    out = [base, base, base.upper(), base + "\n" + say(3), say(60) + " " + part + " " + say(20), part, say(9) + "\t" + part, "", None, "   \n", "one", "one two three", "one two three", say(12), "w " * 40, "w " * 30, say(6000)]
    out += [" ".join(w if rng.random() > 0.02 else "zz" for w in base.split()) for _ in range(25)]
    return [(7 * k + 1, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", 5, "y", "k") for i, t in texts()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def morse() -> tuple[str, str]:
    """Two words of 1,024 characters whose polynomial hashes modulo 2**64 are equal for every base."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_words_of_one_polynomial_hash(spark):
    x, y = morse()
    rest = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}"), (3, x), (4, y), (5, f"{x} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 13}
    assert {r.doc_id: r.component_id for r in ngram_join.similar_components(docs, percent=99).collect()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_equal_hashes_are_not_trusted(monkeypatch):
    """With a word hash that tells nothing but lengths apart, the exact comparisons still do."""
    from evidra.llm import common

    monkeypatch.setattr(common, "hash_words", lambda data, start, end, key=0: common.mix((end - start).astype(np.uint64)))
    w = common.words_of(pa.array(["aa bb cc dd ee ff", "aa bb cc dd ee gg", "bb aa cc dd ee ff", "aa", "bb", "", None, "aa bb cc dd ee aa bb cc dd ee"]))
    owner, shingle = ngram_join.exact_shingles(w, 5)
    sets = [set(shingle[owner == k].tolist()) for k in range(8)]
    assert [len(s) for s in sets] == [2, 2, 2, 1, 1, 0, 0, 5]
    assert len(sets[0] & sets[1]) == 1 and not sets[0] & sets[2] and not sets[3] & sets[4] and len(sets[0] & sets[7]) == 1
    a = substring_dedup._Anchors(pa.record_batch([pa.array([1, 2, 3]), pa.array(["aa bb cc dd", "bb aa cc dd", "aa bb cc dd"])], ["i", "t"]), "i", "t", 3, 4)
    a.runs = lambda hits: np.array([0, 1, 4, 5, 8, 9])
    r = substring_dedup._Runs(a, [], 4)
    h = r.h[r.place].tolist()
    assert len(set(h)) == 4 and h[:2] == h[4:]


def top(root, x):
    while root[x] != x:
        x = root[x]
    return x


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 8), (5, 5), (8, 10), (None, 4), (2, 1)], "a long, b long")
    assert sorted(map(tuple, components(e).collect())) == [(1, 1), (2, 1), (3, 1), (8, 8), (9, 8), (10, 8)]


def test_html_rules():
    page = "<html><head><title>T</title></head><body><nav>Menu</nav><header>Top</header><article><h1>A &amp; B</h1><p>One\n two<b>three</b></p><aside>x</aside><section class='comments'><p>nice</p></section></article><form>f</form><footer>end</footer></body></html>"
    assert html_text.main_text(page) == "A & B One twothree"
    assert html_text.main_text(None) == html_text.main_text("") == ""
    good = "The quick fox is in the house of the lord and it was a good day for all of us to be in this place."
    plain = f"<div id=menu><a href=1>Home</a><a href=2>More</a></div><h2>Head</h2><p>{good}</p><p>Short.</p><div class='ad'>Buy now"
    assert html_text.main_text(plain).startswith(f"Head {good} Short.")


GOOD = "The quick fox is in the house of the lord and it was a good day for all of us to be in this place."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div class='layout has-sidebar'><article><p>{GOOD}</p></article><div class=sidebar>x</div></div>", GOOD),
        (f"<div id=page class='page no-comments'><p>{GOOD}</p></div>", GOOD),
        (f"<form id=aspnetForm><div><p>{GOOD}</p></div></form>", GOOD),
        (f"<div class='widget'><main><p>{GOOD}</p></main><div class=comments><article>nice</article></div></div>", GOOD),
        (f"<article><p>{GOOD}</p></article><div class='related'><article><p>{GOOD} Not this.</p></article></div>", GOOD),
        (f"<div class='site-footer'>end</div><p>{GOOD}</p><div class='cookie-banner'><p>{GOOD}</p></div>", GOOD),
        (f"<p>{GOOD}</p><button>Go<p>{GOOD}</p>", f"{GOOD} Go {GOOD}"),
        (f"<p>{GOOD}</p><script>if (a < b) {{</script><p>İİİ {GOOD}</p><script>x", f"{GOOD} İİİ {GOOD}"),
        (f"<p class=byline>By me<p>{GOOD}<ul><li class=share>Share<li>{GOOD}</ul>", f"{GOOD} {GOOD}"),
        (f"<nav><ul><li><a href=x>{GOOD}</a></li></ul></nav><p>Short.</p>", ""),
        (f"<div class=ad><div>x<p>{GOOD}</p></div><p>y</div><p>{GOOD}</p>", GOOD),
        ("<p>&lt;b&gt; &amp;amp; caf&eacute;&nbsp;x " + GOOD, f"<b> &amp; café x {GOOD}"),
    ],
)
def test_html_pages(page, want):
    assert html_text.main_text(page) == want


def test_html_second_pass_by_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        labels = [rng.choice([True, False, None, None]) for _ in range(rng.randrange(12))]
        heads = [rng.random() < 0.2 for _ in labels]
        want = []
        for k, x in enumerate(labels):
            before = [(k - i, labels[i]) for i in range(k) if labels[i] is not None]
            after = [(i - k, labels[i]) for i in range(k + 1, len(labels)) if labels[i] is not None]
            if x is None:
                near = after[:1] if heads[k] and after else sorted(before[-1:] + after[:1], key=lambda t: t[0])
                x = near[0][1] if near else True
            want.append(x)
        assert html_text.second_pass(labels, True, heads) == want


def test_html_rows(spark):
    rows = [(1, "u", None, 5), (1, None, "", 6), (None, "u", f"<p>{GOOD}", 7), (1, "u", None, 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == sorted([("1", "u", "", 0), ("1", "None", "", 0), ("1", "u", "", 0), ("None", "u", GOOD, len(GOOD))])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_query(spark):
    got = queries.QUERIES["op1_html_extraction"](spark, "/root/testdata/sf0.001").collect()
    assert got and all(r.n_chars == len(r.text) > 0 for r in got)


def test_quality_held_out(spark):
    got = queries.QUERIES["op2_quality_classifier"](spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_quality_moments_and_prior(spark, docs):
    x = quality.features(pa.array([t for _, t in texts()]))
    assert np.allclose(quality._all_moments(docs, "text"), quality.moments(x), rtol=1e-4, atol=1e-4)
    rng = np.random.default_rng(3)
    bins = lambda z: np.bincount(quality._bins(z), minlength=quality.BINS)
    for share in (0.2, 0.6, 0.9):
        mixed = np.where(rng.random(40_000) < share, rng.normal(1, 0.4, 40_000), rng.normal(-1, 0.4, 40_000))
        assert abs(quality.mixture_share(bins(rng.normal(1, 0.4, 4_000)), bins(mixed)) - share) < 0.04
    p, u = rng.normal(1, 1, (300, 1036)), np.concatenate([rng.normal(1, 1, (600, 1036)), rng.normal(-1, 1, (300, 1036))])
    model = quality.fit(quality.moments(p), quality.moments(u), 2 / 3)
    assert (model.score(u[:600]) >= 0.3).mean() > 0.98 and (model.score(u[600:]) < 0.3).mean() > 0.98


def test_quality_repeated_and_null_ids(spark, docs):
    many = docs.withColumn("doc_id", F.when(F.col("doc_id") > 100, F.lit(3)).otherwise(F.lit(None)).cast("long"))
    model = quality.train(many, spark.createDataFrame([(3, 1), (None, 1), (4, 0)], "doc_id long, quality int"))
    assert quality.score(many, model).count() == docs.count()


def test_quality_edges(spark, docs, none):
    model = quality.train(docs, spark.createDataFrame([(1, 1), (8, None)], "doc_id long, quality int"))
    assert {0 <= r.score <= 1 for r in quality.score(docs, model).collect()} == {True}
    assert quality.score(none, quality.train(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0


def test_substring_dedup(docs, none):
    seen, want = {}, {}
    for i, t in texts():
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                gone |= set(range(k, k + 13))
        want[i] = (len(w), len(gone), None if t is None else " ".join(x for k, x in enumerate(w) if k not in gone))
    assert {r.doc_id: (r.n_words, r.n_removed if r.n_words else 0, r.text) for r in substring_dedup.remove_repeats(docs.withColumn("n_words", F.lit("own"))).collect()} == want
    twice = substring_dedup.remove_repeats(docs.unionByName(docs))
    assert twice.count() == 2 * len(want)
    assert substring_dedup.remove_repeats(none).count() == 0


def test_byte_bpe(docs, none):
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path, pattern), path).collect()}
    for i, t in texts():
        assert list(got[i].ids) == enc.encode_ordinary(t or "") and bytes(got[i].decoded) == (t or "").encode()
    spans = {r.doc_id: (r.ids, r.starts, r.ends) for r in bpe.encode(docs, path, pattern, offsets=True).collect()}
    assert all(spans[i][0] == list(got[i].ids) and (not t or spans[i][2][-1] == len(t)) for i, t in texts())
    assert bpe.decode(bpe.encode(none, path, pattern), path).count() == 0


def test_byte_bpe_random_texts():
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    enc = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    rng, cached = random.Random(5), bpe.CachedEncoder(bpe.tokenizer_of(path, pattern))
    plain = bpe.CachedEncoder(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts, words = token_counts.Counts(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _ in range(1500):
        t = "".join(rng.choice(["a", "aa", "B", " ", "  ", "\n", "\t", "é", "中", "1", "'s", "'S", "👍", "-", "<|endoftext|>", "\x1c", "\xa0", "x", ".", ",", "_", "²", "́", "—", "’", "ж", "Ж", "Ž", "İ", "ſ", "Σ", "…", "ǅ"]) for _ in range(rng.randrange(25)))
        assert np.frombuffer(cached([t])[0], "<u4").tolist() == enc.encode_ordinary(t)
        assert np.frombuffer(plain([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids
        pre = counts.pre_tokens(t)
        assert (counts.whole([t])[0] if pre is None else sum(counts.lengths(pre))) == len(words.encode(t, add_special_tokens=False).ids)


def test_token_counts(spark, docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    odd = ["<|startoftext|> a <|endoftext|>", "naïve — “quote” ’s", "Ω Σς ﬁ", "a\u0301 e\u0301", "x" * 5000, "1234 don't I'LL", "\x00\x1c\u2028z", "한국어 テスト", "👍🏽 ok"]
    want = {i: (len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in texts() + [(10_000 + k, t) for k, t in enumerate(odd)]}
    more = docs.unionByName(spark.createDataFrame([(10_000 + k, t, *[None] * 7) for k, t in enumerate(odd)], SCHEMA))
    twice = more.unionByName(more).unionByName(more.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    got = token_counts.token_counts(twice, path, room=100).collect()
    assert len(got) == 2 * len(want) + 1 and all(r.doc_id is None or (r.n_bytes, r.n_tokens) == want[r.doc_id] for r in got)
    assert token_counts.token_counts(none, path).count() == 0


def test_token_counts_query(spark):
    sf = "/root/testdata/sf0.001"
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.QUERIES["op9_token_counts"](spark, sf).collect()}
    n = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in rows.items()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 2048) for i, t in rows.items()}


def test_frequent_pre_tokens_are_those_of_all_documents(spark):
    df = spark.createDataFrame([("aa bb" if k % 2 else f"aa x{k} cc",) for k in range(90)], "text string").repartition(9)
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.frequent_pre_tokens(df, path, table_size=4, fan=2)[0] == "aa"
    assert token_counts.frequent_pre_tokens(df.limit(0), path) == []


def _links(n=5):
    sets = {}
    for i, t in texts():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = top(root, a), top(root, b)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), top(root, i)) for i, s in sets.items()}


@pytest.mark.parametrize("block", [1000, 3])
def test_ngram_join(docs, none, block):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_components(docs, block=block).collect()}
    assert got == _links()
    assert ngram_join.similar_components(none).count() == 0


def test_ngram_join_repeats_and_null_ids(spark, docs):
    more = docs.unionByName(docs).unionByName(docs.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = ngram_join.similar_components(more).collect()
    want = _links()
    assert len(got) == 2 * len(want) + 2
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None for r in got)


def _vector_links(rows: list[tuple], threshold: float = 0.95) -> list[tuple[int, int]]:
    """(n_links, component) of each row by brute force."""
    ok = [i is not None and v is not None and np.isfinite(np.array(v, float)).all() and any(v) for i, v in rows]
    unit = [np.array(v, float) / np.linalg.norm(v) if k else None for (_, v), k in zip(rows, ok, strict=True)]
    near = [[a != b and ok[a] and ok[b] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold for b in range(len(rows))] for a in range(len(rows))]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(len(rows)):
            if near[a][b]:
                x, y = top(root, a), top(root, b)
                root[x] = y
    groups: dict[int, list] = {}
    for a in range(len(rows)):
        groups.setdefault(top(root, a), []).append(rows[a][0])
    return [(sum(near[a]), min((g for g in groups[top(root, a)] if g is not None), default=None)) for a in range(len(rows))]


@pytest.mark.parametrize("block", [2000, 4])
def test_embedding_dedup(spark, block):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    rows = [(k, [float(x) for x in base[k % 6] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.3])]) for k in range(80)]
    rows += [(80, rows[0][1]), (81, rows[0][1]), (82, [0.0] * 16), (83, None), (84, [float("nan")] * 16), (85, [1.0]), (86, [5.0]), (87, [-1.0])]
    rows += [(88, [1.0, 1.0, 0.0]), (89, [2.0, 2.0, 0.1]), (None, rows[0][1]), (3, rows[4][1]), (90, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cid", F.lit("own"))
    got = sorted((str(r.vec_id), r.n_links, r.component_id) for r in embedding_dedup.links(df, block=block).collect())
    assert got == sorted((str(i), *w) for (i, _), w in zip(rows, _vector_links(rows), strict=True))
    assert embedding_dedup.links(df.where("vec_id < 0")).count() == 0
    assert embedding_dedup.links(df.where("vec_id = 82")).first().kept


def test_embedding_recall(spark):
    """12,000 vectors of which 6,000 are partners of others at a cosine of 0.95 to 0.97, the hardest to find."""
    rng = np.random.default_rng(7)
    a, b = rng.standard_normal((2, 6000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.97, (6000, 1))
    v = np.concatenate([a, c * a + np.sqrt(1 - c * c) * b])
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(12_000), "embedding": v.tolist()}))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.links(df).collect()}
    assert len(got) == 12_000 and sum(got[k + 6000] == (1, k) for k in range(6000)) >= 0.9 * 6000
    assert all(n <= 1 for n, _ in got.values())


def test_embedding_estimates_are_unbiased():
    rng = np.random.default_rng(2)
    a, b = rng.standard_normal((2, 400, 32))
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    true, off, within_bound = a @ b.T, [], []
    for seed in range(20):
        frame = embedding_dedup.rotation(32, seed)
        (packed, _, step), (other, factor, _) = (embedding_dedup.encode(x, frame, seed) for x in (a, b))
        about, error = embedding_dedup.estimates(embedding_dedup.decode(packed)[1], step, embedding_dedup.decode(other)[0], factor)
        off.append((about - true).mean())
        within_bound.append((np.abs(about - true) <= error).mean())
    assert abs(np.mean(off)) < 0.01 and min(within_bound) > 0.9995


def test_warc(spark, tmp_path):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(1, "http://a", big), (2, None, big), (3, "u v", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", big), (None, "u", big), (8, "ü", "é" * 700), (7, "u", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.round_trip(pages, f"file://{tmp_path}/w").collect()
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = h == big and i != 7
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", 7 if revisit else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
    assert warc.round_trip(pages.where("page_id < 0"), f"file://{tmp_path}/e").count() == 0
    (tmp_path / "w" / "_left-by-a-lost-task").write_bytes(b"x")
    assert warc.read(spark, f"file://{tmp_path}/w").count() == len(rows)
    wide = pages.withColumn("digest", F.lit(1)).withColumn("payload", F.lit("p"))
    assert warc.write(wide, f"file://{tmp_path}/m", roll=1) == len(rows) == len(list((tmp_path / "m").glob("*.warc.zst")))
    assert warc.read(spark, f"file://{tmp_path}/m").count() == len(rows)
    for faulty in (b"x", warc.record(1, "u", b"abc", "0" * 40, None), warc.record(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)[:-1]):
        with pytest.raises(ValueError):
            warc.parse(faulty)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    assert oracle.actual(queries.QUERIES[name](spark, sf)) == oracle.expected(sf, queries.ORACLE[name])


def _xx(data: bytes, seed: int = 42) -> int:
    return xxhash.xxh64(data, seed=seed & 0xFFFFFFFFFFFFFFFF).intdigest()


def _fingerprint(text: str, lexicon: set[int], subsets: int, seed: int = 11) -> str:
    """The written fingerprint by plain Python."""
    every = {_xx(w.encode()) for w in re.split(r"[\x20\x09-\x0D]+", text.lower()) if w}
    used, bits = every & lexicon or every, subsets.bit_length() - 1
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    of = lambda h, s: signed(_xx(s.to_bytes(4, "little"), _xx(h.to_bytes(8, "little"))))
    parts: dict[int, list[int]] = {}
    for h in used:
        first = of(h, seed) % subsets
        for k in (first, (first + 1 + of(h, seed + 1) % (subsets - 1)) % subsets):
            parts.setdefault(k, []).append(signed(k << 64 - bits | h >> bits))
    out = []
    for k in range(subsets):
        x = 42
        for t in sorted(parts.get(k, [])):
            x = _xx((t & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), x)
        out.append(f"{x:016X}"[-4:] if k in parts else "----")
    return "".join(out)


def _lexicon(values: list[str]) -> set[int]:
    df: dict[str, int] = {}
    for t in values:
        for w in {w for w in re.split(r"[\x20\x09-\x0D]+", t.lower()) if w}:
            df[w] = df.get(w, 0) + 1
    return {_xx(w.encode()) for w, n in df.items() if 1.6 <= np.log(len(values) / n) <= 5.3}


def test_imatch(docs, none):
    got = {r.doc_id: r for r in imatch.fingerprints(docs, bits=2, subsets=16).collect()}
    order = sorted(((i, t or "") for i, t in texts()), reverse=True)
    words = _lexicon([t for _, t in order])
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1]
        m = len(t) // 3
        edited = t[: len(t) - m] + n[:m]
        own, other, following = (_fingerprint(x, words, 16) for x in (t, edited, n))
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own, other)
        for near, x in ((got[i].near_edited, other), (got[i].near_next, following)):
            cut = [(own[c : c + 4], x[c : c + 4]) for c in range(0, 64, 4)]
            used = [p for p in cut if p != ("----", "----")]
            assert near == pytest.approx(sum(p == q for p, q in used) / len(used) if used else 1.0)
    assert imatch.fingerprints(none).count() == 0


def test_imatch_subsets_overlap():
    words = [f"word{k}" for k in range(2000)]
    hit = sum(_fingerprint(w, set(), 256).count("----") != 254 for w in words)
    assert hit == 0  # each term is in two different subsets


def test_imatch_shared_and_null_ids(spark):
    rows = [(9, "a b c d e f"), (5, "g h i j k l"), (5, "m n o"), (5, "m n o"), (2, "p q r s t u"), (None, "x y z"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.edited_sha256) for r in imatch.fingerprints(df, bits=1).collect())
    follow = {9: "m n o", 5: "p q r s t u", 2: "x y z", None: "a b c d e f"}
    want = []
    for i, t in rows:
        t = t or ""
        k = len(t) // 3
        want.append((str(i), hashlib.sha256((t[: len(t) - k] + follow[i][:k]).encode()).hexdigest()))
    assert got == sorted(want)


def test_imatch_with_a_lexicon_of_any_size(docs):
    """Beyond its bound the lexicon is a table that is joined: the same fingerprints."""
    by_set, by_join = (sorted(map(tuple, imatch.fingerprints(docs, bits=2, subsets=16, most=n).collect())) for n in (1_000_000, 2))
    assert by_set == by_join and not isinstance(imatch.lexicon(docs.select("text"), most=2), list)


def test_successors(spark):
    ids = spark.createDataFrame([(x,) for x in (-900, -3, 0, 5, 256, 70000, 70001, 1 << 40, None)], "g long")
    got = {r.g: r.after for r in imatch.successors(ids, most=3, bits=4).collect()}
    order = [1 << 40, 70001, 70000, 256, 5, 0, -3, -900, None]
    assert got == {a: b for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_packing(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path).toPandas()
    for i, t in texts():
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.start.tolist() == np.cumsum([0, *own.length])[:-1].tolist() and own.length.sum() == len(ids)
        assert (own.length.iloc[1:] == 1024).all() and (len(ids) > 1024 or len(own) == 1)
        for r in own.itertuples():
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids == raw and r.ids_crc32 == zlib.crc32(raw)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == np.cumsum([0, *s.length])[:-1].tolist() and s.length.sum() <= 1024
    assert packing.pack_documents(none, path).count() == 0


def test_sum_of_squares_choice():
    sequence, offset = packing.sum_of_squares(np.array([6, 6, 4, 4, 10]), 10)
    assert sequence.tolist()[:2] == [0, 1] and sorted(sequence.tolist()[2:4]) == [0, 1] and offset.tolist() == [0, 0, 6, 6, 0]


def brute_pipeline(accepted: list[tuple]) -> dict:
    """The texts by id that stages 2 to 4 leave of accepted rows (doc_id, text) with distinct ids: shingle sets compared pair by
    pair where they meet, components by relabelling, windows in a dictionary."""
    def shingles(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    sets = {i: shingles(t) for i, t in accepted}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in sets}
    pairs = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    single = sorted((i, t) for i, t in accepted if root[i] == i)
    first, out = {}, {}
    for i, t in single:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    for i, t in single:
        w = WORD.findall(t or "")
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t or ""
    return out


def check_packed(packed, texts: dict) -> None:
    """Every text's ids are there once, in order, and sequences have no gap and no more than 1024 ids."""
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    total = 0
    for i, t in texts.items():
        ids, at = np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4"), 0
        for n, r in enumerate(sorted(by_doc[i], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (n, at) and zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids) and (len(by_doc[i]) == 1 or len(ids) > 1024)
        total += len(ids)
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= 1.02 * -(-total // 1024) + 1


def test_pipeline(spark, tmp_path):
    """The whole run against brute force on all that the trained classifier accepts."""
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = p.good_quality(spark, docs, sf)
    scored = quality.score(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("predicted = 1").select("doc_id")
    accepted = [(r.doc_id, r.text) for r in good.select("doc_id", "text").collect()]
    assert good.columns == docs.columns and sorted(i for i, _ in accepted) == sorted(r.doc_id for r in scored.collect()) and 700 < len(accepted) < 1000
    want = brute_pipeline(accepted)
    assert len(want) < len(accepted) and any(len(want[i]) < len(t) for i, t in accepted if i in want)
    check_packed(p.run(spark, sf).collect(), want)
    assert len(p.STAGES) == 4 and p.ORACLE_SQL is None


def test_html_keeps_offsets_and_what_follows_unclosed_elements():
    assert all(len(html_text._lower(chr(c))) == 1 for c in range(0x110000))
    text = "The story of the town is long and it was told by those who were there. " * 5
    one, two = f"<p>{chr(0x130) * 300} {text}</p>", f"<p>{text}</p>"
    assert html_text.main_text(f"{one}<script>x</SCRIPT>{two}").count("The story") == 10
    for name in ("select", "button", "object", "svg", "video"):
        assert html_text.main_text(f"{two}<{name}>{two}").count("The story") == 10
    assert html_text.main_text(f"{two}<script>{two}").count("The story") == 5


def test_null_and_repeated_ids_and_clashing_columns(spark):
    """Rows with null ids, repeated ids and columns of the operators' own names go through operators 3, 4 and 10."""
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(2, passage), (None, passage), (2, passage), (1, None), (None, None), (3, "own " + passage)]
    docs = spark.createDataFrame([(i, t, "x", 1, b"z") for i, t in rows], "doc_id long, text string, hits string, ids int, blob binary")
    got = sorted((str(r.doc_id), str(r.text), r.n_removed, r.hits, r.ids) for r in substring_dedup.remove_repeats(docs).collect())
    want = [(2, passage, 0), (2, passage, 0), (3, "own", 20), (None, "", 20), (1, None, 0), (None, None, 0)]
    assert got == sorted((str(i), str(t), n, "x", 1) for i, t, n in want)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = bpe.decode_text(bpe.encode(docs, path, pattern), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in both) == sorted((str(i), t or "") for i, t in rows)
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(i) for i, _ in rows)


def test_decoded_text_of_split_characters(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.read_ranks(path)
    half = [ranks[b"\xe4"], ranks[b"\xb8"]]
    rows = [(1, [*half, ranks[b"\xad"]]), (2, half), (3, None), (4, [])]
    got = {r.doc_id: r.text for r in bpe.decode_text(spark.createDataFrame(rows, "doc_id long, ids array<int>"), path).collect()}
    assert got == {1: "中", 2: "\ufffd", 3: "", 4: ""}
    with pytest.raises(Exception, match="ids outside"):
        bpe.decode(spark.createDataFrame([(1, [1 << 20])], "doc_id long, ids array<int>"), path).collect()


def test_packing_groups_do_not_follow_ids(spark):
    parts = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 900 + 1).alias("length"))
    packed = packing.pack(parts, group_size=100).toPandas()
    assert packed.groupby(packed.sequence_id // (1 << 32)).size().max() < 200 and len(packed) == 3000


def test_packing_makes_few_sequences(spark):
    packed = queries.QUERIES["op10_packing"](spark, "/root/testdata/sf0.01").toPandas()
    assert packed.sequence_id.nunique() <= 1.02 * -(-packed.length.sum() // 1024)


def test_one_of_each_group(spark):
    words = " ".join(f"w{k}" for k in range(30))
    other = " ".join(f"v{k}" for k in range(30))
    rows = [(5, words), (2, words + " end"), (2, other), (7, other), (9, "alone"), (9, "Alone"), (4, None), (4, ""), (None, words), (None, words), (8, None), (1, "apart " * 9)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, _key int")
    got = sorted((str(r.doc_id), str(r.text)) for r in ngram_join.one_of_each(docs).collect())
    want = [(2, words + " end"), (2, other), (9, "Alone"), (4, None), (None, words), (None, words), (8, None), (1, "apart " * 9)]
    assert got == sorted((str(i), str(t)) for i, t in want)
    assert ngram_join.one_of_each(docs.limit(0)).count() == 0 and ngram_join.one_of_each(docs).columns == docs.columns


def test_pipeline_of_odd_rows(spark, tmp_path, monkeypatch):
    """Null and repeated ids, empty texts and other columns; the classifier accepts all but one source here."""
    import corpus_pipeline as p

    monkeypatch.setattr(quality, "train", lambda docs, labels: None)
    monkeypatch.setattr(quality, "accepted", lambda docs, model: docs.where("source is null or source <> 'junk'"))
    words = " ".join(f"word{k} and the" for k in range(40))
    other = " ".join(f"other{k}" for k in range(30))
    rows = [(k, f"{words} {k}", "en", "s", 1, None) for k in range(12)]
    rows += [(3, other, None, None, None, "z"), (3, other.upper(), "en", "s", 5, "z"), (None, None, None, None, None, "z"), (None, f"{other} tail", "en", "s", 2, "z"), (None, f"own {words} 0", "en", "s", 2, "z"), (50, "", "en", "s", 0, "z"), (51, "kept", "en", "junk", 4, "z"), (60, f"lead {other}", "en", "s", 4, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, piece string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array(lib.encode(t, add_special_tokens=False).ids + [2], "<u4").tobytes())
    # 0 stands for its near copies; of id 3 the smaller of two texts that are alike stays; 60 is a near copy of it; null ids link
    # with nothing, and lose what an id has in the same letters
    want = [(0, f"{words} 0"), (3, other.upper()), (None, ""), (None, f"{other} tail"), (None, "own"), (50, "")]
    got = p.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(i), crc(t)) for i, t in want)
    assert all(r.offset + r.length <= 1024 and r.piece == 0 for r in got)


def test_join_of_near_copies_under_one_id(spark):
    """Near copies of a long text under one id, and the same under ids of their own: the same links, one text a class."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(4000)}" for _ in range(1200)]
    copies = [" ".join(base[: 3 * k] + [f"new{k}"] + base[3 * k + 1 :]) for k in range(250)]
    rows = [(7, t) for t in copies] + [(1000 + k, t) for k, t in enumerate(copies)] + [(9, "one two three four five six seven")] * 3
    got = ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.component_id for r in got} == {9: 9, **{r[0]: 7 for r in rows if r[0] != 9}} and len(got) == len(rows)


def test_join_filters_work_in_groups_of_every_size():
    """Of entries of one shingle whose sizes lie too far apart none stays, however many there are; brute force elsewhere."""
    rng = np.random.default_rng(2)

    def entries(size, token, at=None):
        n = len(size)
        hist = np.zeros((n, ngram_join.BINS), np.uint8)
        hist[:, 0] = np.minimum(size, 255)
        return {"token": token, "node": np.arange(n), "size": size, "at": np.zeros(n, np.uint32) if at is None else at, "score": rng.random(n).astype(np.float32), "hist": hist}

    far = np.unique((1.3 ** np.arange(10, 75)).astype(np.uint32))
    assert len(ngram_join.pivots_of(entries(far, np.zeros(len(far), np.uint64)), 80)) == 0
    many = entries(rng.integers(100, 5_000, 3_000).astype(np.uint32), np.zeros(3_000, np.uint64))
    many["hist"] = rng.integers(0, 20, (3_000, ngram_join.BINS)).astype(np.uint8)
    many["at"] = (many["size"] // 10 * rng.integers(0, 3, 3_000)).astype(np.uint32)
    few = entries(rng.integers(1, 300, 400).astype(np.uint32), rng.integers(0, 9, 400).astype(np.uint64), rng.integers(0, 40, 400).astype(np.uint32))
    for e in (few, many):
        i, j = np.triu_indices(len(e["size"]), 1)
        same = e["token"][i] == e["token"][j]
        i, j = i[same], j[same]
        ok = ngram_join._passes(e, i, j, 80)
        want = set(i[ok].tolist()) | set(j[ok].tolist())
        assert set(ngram_join.pivots_of(e, 80)[:, 0].tolist()) == want and 0 < len(want) < len(e["size"])


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<p title=it's><article><p>{GOOD}</p></article><p>it's</p>", GOOD),  # a quote in an unquoted value opens nothing
        (f'<a title="a > b">x</a><p>{GOOD}</p><a title="never closed>y</a>', GOOD),
        (f"<div><p>{GOOD}</p><p>{GOOD}</p></div><article class='teaser card'><p>{GOOD} Not this.</p></article><article class='teaser card'><p>{GOOD} Nor this.</p></article>", f"{GOOD} {GOOD}"),
        (f"<article><p>{GOOD}</p><article class='comment'><p>{GOOD} no</p></article><article><p>{GOOD} no</p></article></article>", GOOD),
        (f"<div class='social-history'><p>{GOOD}</p></div><div class='social-links'><p>{GOOD} no</p></div>", GOOD),
        (f"<article><p>{GOOD}</p></article><article><p>{GOOD} Second.</p></article>", f"{GOOD} {GOOD} Second."),  # two: none bounds the page
        (f"<article class='list'><article><p>{GOOD}</p></article><article><p>{GOOD}</p></article></article>", f"{GOOD} {GOOD}"),
        (f"<article class='post tag-alert'><p>{GOOD}</p></article>", GOOD),
        (f"<div><p>{GOOD}</p></div><article><p>Short.</p></article>", f"{GOOD} Short."),
    ],
)
def test_html_articles_and_attributes(page, want):
    assert html_text.main_text(page) == want


def test_html_without_articles(spark):
    """The test pages with divs in place of their articles have the same text."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r.html]
    assert len(pages) > 200
    for p in pages:
        assert html_text.main_text(re.sub("<(/?)article", r"<\1div", p)) == html_text.main_text(p)


@pytest.mark.parametrize("piece", ["<p title='it>a ", "<p title=\"x>a</p> <p title='it>", "<a x=1 ", "<script <div> </script", "<div class=ad>x", "<select>x", "<!--x", "<article>x", "<div class=ad><form>x</form></div>", "</article><article class=ad>"])
def test_html_takes_linear_time(piece):
    import time

    def took(n: int) -> float:
        start = time.process_time()
        html_text.main_text(piece * n)
        return time.process_time() - start

    n = 50_000 // len(piece)
    assert took(20 * n) < 25 * max(took(n), 0.02)


def test_html_blocks_by_brute_force():
    """Both passes on pages of random blocks in random regions, without elements that bound or wrap."""
    rng = random.Random(8)
    kinds = {"nav": True, "div": False, "section": False, "aside": True, 'div class="cookie-bar"': True, "footer": True}
    for _ in range(200):
        page, want = [], []
        for _ in range(rng.randrange(1, 8)):
            tag = rng.choice(list(kinds))
            body = []
            for _ in range(rng.randrange(1, 4)):
                text = rng.choice([GOOD, "Short one.", "zzz " * 60, f"{GOOD} {GOOD}"]).strip()
                link = rng.random() < 0.2
                body.append((text, link))
            page.append(f"<{tag}>" + "".join(f"<p><a href=x>{t}</a></p>" if link else f"<p>{t}</p>" for t, link in body) + f"</{tag.split()[0]}>")
            if not kinds[tag]:
                for t, link in body:
                    words = t.lower().split()
                    stops = sum(w.strip(".") in html_text.STOP for w in words) / len(words)
                    label = False if link else True if len(t) >= 70 and stops >= (0.3 if len(t) < 200 else 0.15) else None
                    want.append((t, label))
        if not any(label for _, label in want):
            continue  # then regions may be wrappers
        labels = [x for _, x in want]
        decided = [k for k, x in enumerate(labels) if x is not None]
        kept = [t for k, (t, x) in enumerate(want) if (labels[min(decided, key=lambda d: (abs(d - k), d))] if x is None else x)]
        assert html_text.main_text("".join(page)) == " ".join(kept)
