"""Operators 11 to 13 against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from evidra.llm import line_dedup, merkle, ranked_search  # noqa: E402
from test_growth import most_rows  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row long, g string, term string, pos long, item string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def table(spark, rows):
    """rows: (doc_id, text, lang); the other columns have names that the operators use themselves."""
    full = [(i, t, g, None if i and i % 5 == 0 else "sörce", len(t) if t is not None else None, "x", 3, "y", "z", 7, "w") for i, t, g in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


def corpus() -> list[tuple]:
    rng = random.Random(11)
    words = ["The", "of", "É", "中文", "naïve", "x9", "b-c", "d_e", "a\x0bb", "ﬁ", "İ", "zebra", "42", "<p>"] + [f"w{k}" for k in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long_line, other = "  A line that is longer than FORTY code points, é. ", "\tanother line of more than forty code points, yes\r"
    rows = [(k, say(rng.randrange(1, 80)), rng.choice(["en", "en", "en", "de", None])) for k in range(1, 60)]
    rows += [(k, f"{long_line}\n{say(3)}\n{long_line.lower()}\n{other if k % 2 else say(9)}\n", "en") for k in range(100, 112)]
    rows += [(200, None, "fr"), (201, "", "fr"), (202, " \n\n ", "fr"), (203, "!!", None), (204, say(9000), "es"), (None, f"{long_line}\n{other}", "en"), (None, None, None)]
    return rows + [(300, rows[3][1], "en")] * 4 + [(300, other, "en"), (7, rows[6][1], "de")]


def score_all(rows, text: str) -> list[tuple]:
    found = [(i, TERM.findall(lower(t or ""))) for i, t, _ in rows]
    found = [(i, ts) for i, ts in found if ts]
    n_docs, total = len(found), sum(len(ts) for _, ts in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for i, ts in found:
        tf, m = Counter(ts), 25 + 75 * len(ts) * n_docs // total
        s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t in TERM.findall(lower(text)) if t in tf)
        if s > 0:
            out.append((-s, i is None, i))
    return sorted(out)[:10]


@pytest.mark.parametrize("shape", [{}, {"shard_bytes": 300, "block": 2, "step": 1}])
def test_ranked_search(spark, shape):
    rows = corpus()
    items = [(1, "the zebra of zebra W3"), (2, None), (3, "!?"), (4, "unknownterm"), (5, rows[70][1]), (6, "中文 É w1 w2"), (6, "w1 İ"), (None, "x9"), (8, rows[-6][1])]
    got = ranked_search.rank_documents(table(spark, rows), spark.createDataFrame(items, "item_id long, text string"), **shape).collect()
    merged = defaultdict(str)
    for k, t in items:
        merged[k] += " " + (t or "")
    want = {(k, rank, i, -s) for k, t in merged.items() for rank, (s, _, i) in enumerate(score_all(rows, t), 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_ranked_search_stops_early_and_keeps_ties():
    """One document far ahead, many behind: the lists are not read to their end, and ties at the last place are all seen."""
    texts = pa.array(["rare rare word"] + ["word " * 3 + "filler " * k for k in range(400)] + ["word"] * 5)
    words = ranked_search._terms_of(texts)
    vocabulary = sorted({t for x in texts.to_pylist() for t in x.split()})
    post = sorted(((k, vocabulary.index(t)), c) for k, x in enumerate(texts.to_pylist()) for t, c in Counter(x.split()).items())
    size = Counter(d for (d, _), _ in post)
    flat = [len(x.split()) for x in texts.to_pylist()] + [size[k] for k in range(len(texts))] + [t for (_, t), _ in post] + [c for _, c in post]
    import zstandard

    shard = ranked_search.Shard(pa.array(vocabulary), zstandard.compress(np.array(flat, "<i4").tobytes()), len(texts), len(texts), int(words.first[-1]))
    term, weight = np.array([vocabulary.index("rare"), vocabulary.index("word")]), np.array([6000, 2])
    docs, scores, read = ranked_search.threshold_top(shard, term, weight, 3, 4, np.zeros(len(vocabulary), np.int64))
    assert read < 60 and 0 in docs.tolist()
    every = shard.scores(np.arange(len(texts)), np.array([6000 if v == "rare" else 2 if v == "word" else 0 for v in vocabulary]))
    third = np.sort(every)[-3]
    assert set(docs.tolist()) == set(np.flatnonzero(every >= third).tolist()) and (scores == every[docs]).all()


def test_ranked_search_of_nothing(spark):
    docs, items = table(spark, corpus()), spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert ranked_search.rank_documents(docs.limit(0), items).count() == 0
    assert ranked_search.rank_documents(docs, items.limit(0)).count() == 0


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def fold_levels(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels: list[list[str]], pos: int) -> list[tuple[str, str]]:
    out = []
    for level in levels[:-1]:
        out.append(tuple("" if not 0 <= p < len(level) else level[p] for p in ((pos - 1, None) if pos % 2 else (None, pos + 1)) if p is not None) + ("left" if pos % 2 else "right",))
        pos //= 2
    return out


def brute_manifest(rows) -> list[tuple]:
    say = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    told = defaultdict(list)
    for i, t, g in rows:
        n = len(t) if t is not None else None
        parts = lambda n: h(say(i), say(None if i and i % 5 == 0 else "sörce"), say(g), say(n), say(t))  # noqa: B023, E731
        hit = i is not None and zlib.crc32(str(i).encode()) % 7 == 0
        told[g].append((i is not None, i or 0, parts(n), parts(n + 1 if hit and n is not None else n), i))
    groups = sorted(told, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: fold_levels([x[2] for x in sorted(told[g])]) for g in groups}
    top = fold_levels([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for pos, (_, _, leaf, claimed, i) in enumerate(sorted(told[g])):
            steps, now = path(trees[g], pos) + path(top, k), claimed
            for sibling, side in steps:
                now = h(sibling, now) if side == "left" else h(now, sibling)
            root = top[-1][0]
            out.append((i, leaf, trees[g][-1][0], root, h(*[s for s, _ in steps]), now, now == root))
    return out


@pytest.mark.parametrize("bits", [1, 2, 3, 12])
def test_manifest(spark, bits):
    rows = corpus() + [(1000 + k, "t", f"lang{k}") for k in range(6)]
    docs = table(spark, rows)
    changed = {"n_chars": F.col("n_chars") + F.when(merkle.tampered(F.col("doc_id")), 1).otherwise(0)}
    got = merkle.verify(merkle.manifest(docs, changed=changed, bits=bits)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    key = lambda r: tuple(map(str, r))
    want = brute_manifest(rows)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_of_few(spark):
    docs = table(spark, [(1, "a", "en")])
    assert merkle.verify(merkle.manifest(docs)).select("verified", (F.col("leaf") == F.col("root")).alias("same")).collect() == [(True, True)]
    assert merkle.verify(merkle.manifest(docs.limit(0))).count() == 0


def test_leaves_meet_blocks_not_siblings(spark):
    docs = table(spark, [(k, f"text {k}", "en") for k in range(600)])
    assert most_rows(spark, merkle.manifest(docs)) <= 600  # a row for each level of each leaf would be 6,000


def brute_lines(rows, shortest=40, least=5):
    strip = lambda x: lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    held = defaultdict(list)
    for i, t, _ in rows:
        for k in {strip(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    last = {k: max((i for i in v if i is not None), default=None) for k, v in held.items() if len(k) >= shortest and len(v) >= least}
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if strip(x) not in last or last[strip(x)] in (i, None)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("shape", [{}, {"shard_keys": 1, "task_probes": 2}])
def test_line_dedup(spark, shape):
    rows = corpus()
    got = line_dedup.drop_repeated_lines(table(spark, rows), **shape).collect()
    want = brute_lines(rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and sum(r[2] for r in want) > 20


def test_line_dedup_of_string_ids_and_nothing(spark):
    rows = [(str(i), t, g) for i, t, g in corpus() if i is not None]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    assert sorted(map(tuple, line_dedup.drop_repeated_lines(docs).collect())) == sorted(brute_lines(rows))
    assert line_dedup.drop_repeated_lines(docs.limit(0)).count() == 0
    only_null = spark.createDataFrame([(None, "x" * 50)] * 6, "doc_id string, text string")
    assert {tuple(r) for r in line_dedup.drop_repeated_lines(only_null).collect()} == {(None, 1, 0, "x" * 50)}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, max(n // 2, 1), n).astype(np.uint64), np.arange(n, dtype=np.uint64)
    found = line_dedup.PerfectHash.of(h1, h2)
    again = line_dedup.PerfectHash.unpacked(found.packed())
    assert sorted(again.number(h1, h2).tolist()) == list(range(n))
    if n:
        assert again.number(h1 + np.uint64(1 << 40), h2).max() < n
