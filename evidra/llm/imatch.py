"""Operator 8: I-Match fingerprints with DataFrame functions only.

Terms are words `[^\\x20\\x09-\\x0D]+` in lower case, as 64-bit hashes. Document frequencies count all
documents. The lexicon keeps terms whose inverse document frequency ln(N / df) lies in a band, as a stored table; its
size has a proven bound: as the frequencies sum to N times the mean number of distinct terms, at most
mean * exp(max_idf) terms reach the band. Up to `most` terms (counted) are a set within the plan; more are
joined with the terms of the texts, with the same result. Each lexicon term belongs to two of `subsets`
randomised subsets, so that subsets overlap; a document's distinct terms of a subset, sorted, are hashed. A fingerprint
is all these hashes, and the likeness of two is the share of equal ones among the subsets that either uses. A text
without a term in the band uses all its terms instead.

Defined cases: null text is the empty text; a fingerprint without terms has no used subset, and two such
are alike (1.0); equal texts have equal fingerprints; the next document of a row is that of the next smaller id, null
ids last, and of rows that share an id the largest text stands for all of them; a single id is its own next; an empty
table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

_WHITE = r"[\x20\x09-\x0D]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text as hashes."""
    words = F.split(F.lower(text), _WHITE)
    return F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text_col: str = "text", min_idf: float = 1.6, max_idf: float = 5.3, most: int = 1_000_000) -> list[int] | DataFrame:
    """Hashes of the terms in the band, from all documents: a sorted list of at most most, else a stored table (h)."""
    each = docs.select(F.explode(F.array_distinct(F.split(F.lower(text_col), _WHITE))).alias("w")).where("w <> ''")
    count = each.groupBy(F.xxhash64("w").alias("h")).agg(F.count("*").alias("df"))
    idf = F.log(F.lit(float(max(docs.count(), 1))) / F.col("df"))
    words = stored(count.where(idf.between(min_idf, max_idf)).select("h"), "lexicon")
    return words if words.count() > most else sorted(r.h for r in words.collect())


def _in_band(rows: DataFrame, words: list[int] | DataFrame) -> DataFrame:
    """rows with _band, the terms of _every that the lexicon holds."""
    if isinstance(words, list):
        member = f"h in ({', '.join(map(str, words))})" if words else "false"
        return rows.withColumn("_band", F.expr(f"filter(_every, h -> {member})"))
    rows = stored(rows.withColumn("_n", F.monotonically_increasing_id()), "texts")  # so that both readers see the same numbers
    held = rows.select("_n", F.explode("_every").alias("h")).join(words, "h", "left_semi").groupBy("_n").agg(F.collect_list("h").alias("_band"))
    return rows.join(held, "_n", "left").withColumn("_band", F.coalesce("_band", F.array().cast("array<bigint>"))).drop("_n")


def with_fingerprint(rows: DataFrame, text_col: str, name: str, words: list[int] | DataFrame, subsets: int = 256, seed: int = 11) -> DataFrame:
    """rows with an array of one hash per subset (a power of two), null where the text has no term of it."""
    bits = subsets.bit_length() - 1
    rows = _in_band(rows.withColumn("_every", terms(F.col(text_col))), words)
    rows = rows.withColumn("_used", F.when(F.size("_band") > 0, F.col("_band")).otherwise(F.col("_every"))).drop("_every", "_band")
    entry = lambda k, h: F.shiftleft(F.pmod(k, F.lit(subsets)), 64 - bits).bitwiseOR(F.shiftrightunsigned(h, bits))
    first = lambda h: F.pmod(F.xxhash64(h, F.lit(seed)), F.lit(subsets))
    second = lambda h: first(h) + 1 + F.pmod(F.xxhash64(h, F.lit(seed + 1)), F.lit(subsets - 1))
    dealt = F.flatten(F.transform("_used", lambda h: F.array(entry(first(h), h), entry(second(h), h))))
    rows = rows.withColumn("_ordered", F.array_sort(dealt)).drop("_used")

    def one(k: Column, of: Column) -> Column:
        own = F.filter(of, lambda t: F.shiftrightunsigned(t, 64 - bits) == k)
        return F.transform(F.array(own), lambda o: F.when(F.size(o) > 0, F.xxhash64(o)))[0]

    step = 1 << bits // 2  # first by the upper bits of the subset, so that each term is tried step + subsets / step times

    def some(c: Column, of: Column) -> Column:
        part = F.filter(of, lambda t: F.shiftrightunsigned(t, 64 - bits + bits // 2) == c)
        return F.transform(F.array(part), lambda p: F.transform(F.sequence(c * step, c * step + step - 1), lambda k: one(k, p)))[0]

    parts = F.sequence(F.lit(0).cast("long"), F.lit(subsets // step - 1).cast("long"))
    # bound by a lambda, so that the optimiser cannot move the sort into the loop over the subsets
    hashes = F.transform(F.array("_ordered"), lambda of: F.flatten(F.transform(parts, lambda c: some(c, of))))[0]
    return rows.withColumn(name, hashes).drop("_ordered")


def likeness(a: Column, b: Column) -> Column:
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(used == 0, 1.0).otherwise(same / used)


def written(f: Column) -> Column:
    """A fingerprint as a string of four characters a subset."""
    return F.array_join(F.transform(f, lambda x: F.coalesce(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(4)), F.lit("----"))), "")


def successors(ids: DataFrame, most: int = 100_000, bits: int = 8) -> DataFrame:
    """(g, after): each distinct g and the next smaller one (the largest after the smallest); null counts as smallest.

    In groups of neighbours by windows; groups' borders recursively, until one window holds at most `most` rows.
    """
    ids = stored(ids.select("g").distinct(), "ids")
    order = lambda c: F.col(c).desc_nulls_last()
    if ids.count() <= most:
        w = Window.partitionBy(F.lit(0)).orderBy(order("g"))
        first = F.max("g").over(Window.partitionBy(F.lit(0)))
        return ids.select("g", F.when(F.lead(F.lit(True)).over(w), F.lead("g").over(w)).otherwise(first).alias("after"))
    up = ids.withColumn("u", F.shiftright("g", bits))
    heads = up.groupBy("u").agg(F.max("g").alias("head"))
    over = successors(heads.select(F.col("u").alias("g")), most, bits).withColumnRenamed("g", "u")
    linked = over.alias("o").join(heads.alias("h"), F.expr("o.after <=> h.u"), "left").select(F.col("o.u").alias("u"), F.col("h.head").alias("head"))
    w = Window.partitionBy("u").orderBy(order("g"))
    inner = up.select("u", "g", F.lead(F.lit(True)).over(w).alias("more"), F.lead("g").over(w).alias("a"))
    return inner.alias("i").join(linked.alias("l"), F.expr("i.u <=> l.u"), "left").select("i.g", F.when(F.col("i.more"), F.col("i.a")).otherwise(F.col("l.head")).alias("after"))


def _followed(docs: DataFrame, words: list[int] | DataFrame, bits: int, subsets: int) -> DataFrame:
    """(id, text, shared, following, own, next_print): each row with the next one's text and fingerprint; ids are distinct.

    The text is shuffled once, to groups of 2**bits neighbouring ids; windows, joins and results stay there.
    """
    docs = docs.withColumn("g", F.shiftright("id", bits))
    heads = docs.groupBy("g").agg(F.max(F.struct("id", "text")).alias("h")).select("g", F.col("h.text").alias("head"))
    after = successors(docs.select("g"), bits=bits)
    heads = after.alias("a").join(heads.alias("h"), F.expr("a.after <=> h.g")).select(F.coalesce(F.col("a.g"), F.lit(-(1 << 62))).alias("g"), "head")
    heads = stored(with_fingerprint(heads, "head", "head_print", words, subsets), "heads")
    rows = docs.withColumn("g", F.coalesce("g", F.lit(-(1 << 62))))
    w = Window.partitionBy("g").orderBy(F.col("id").desc_nulls_last())
    rows = rows.withColumn("following", F.lead("text").over(w)).join(heads, "g", "left").withColumn("following", F.coalesce("following", "head")).drop("head")
    rows = with_fingerprint(rows, "text", "own", words, subsets)
    return rows.withColumn("next_print", F.coalesce(F.lead("own").over(w), "head_print")).drop("head_print", "g")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 8, subsets: int = 256, most: int = 1_000_000) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the last third replaced by the start of the next document), and likenesses."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    words = lexicon(docs, most=most)
    again = stored(docs.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "again")
    shared = not again.isEmpty()
    unique = docs.withColumn("shared", F.lit(False))
    if shared:  # one row stands for each such id; the rows themselves take what follows it
        both = F.expr("d.id <=> a.id")
        rest = docs.alias("d").join(again.alias("a"), both, "left_semi")
        most = rest.groupBy("id").agg(F.max("text").alias("text")).withColumn("shared", F.lit(True))
        unique = unique.alias("d").join(again.alias("a"), both, "left_anti").unionByName(most)
    rows = _followed(unique, words, bits, subsets)
    if shared:
        near = stored(rows.where("shared").select("id", "following", "next_print"), "following")
        rest = rest.alias("d").join(near.alias("a"), both).select("d.id", "d.text", "a.following", "a.next_print")
        rows = rows.where("not shared").drop("shared").unionByName(with_fingerprint(rest, "text", "own", words, subsets))
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    rows = rows.select("id", "own", "next_print", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - k), F.substring("following", F.lit(1), k)).alias("edited"))
    rows = with_fingerprint(rows.withColumn("edited_sha256", F.sha2(F.encode("edited", "UTF-8"), 256)), "edited", "other", words, subsets)
    return rows.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_print")).alias("near_next"))
