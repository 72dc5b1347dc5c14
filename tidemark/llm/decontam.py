"""Benchmark decontamination with a distributed positional inverted index over the training documents.

1. Documents are split into words once; the words are kept as a scratch table.
2. Benchmark items become windows (13 words; shorter items are one window). Equal windows are one row.
3. Corpus frequencies of the benchmark's terms are counted over all documents; a window with an absent term can't occur.
4. Postings of each window's two rarest terms are stored as a Parquet index: (term, document, positions), a row for each term
   and document, however often the one stands in the other.
5. Offset-adjusted position lists are intersected from the rarest term on. Where both terms place a window's start alike it is a
   candidate; where they place it at most `slop` words apart it is a proximity match.
6. Candidates meet their document's words, where the phrase is compared as a whole (by 64-bit hash; windows of one and two words
   need no such check). A document's candidates are numbers alone: a window's id, length and starts, at most as many as
   the document has words a window. Items join in after that, a row for each document and item.

Built-in functions and equi-joins only. Only tables below Spark's broadcast threshold are broadcast, by its own size check; a
larger benchmark takes the shuffled join, which adaptive execution splits where a term is hot. Texts are never shuffled, and
words only those of documents with candidates (and of few others, as a filter of fixed size tells them apart).

Defined results: null or empty texts have no words, no hits and are clean; rows that share doc_id and text are judged alike,
also without doc_id; items without words match nothing; items without item_id mark words but are not listed; an empty table on
either side is fine; other columns of the documents pass through unless they carry the name of a result column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, drop, shared_folder, written

WINDOW = 13
SLOP = 5
#: What separates words after lower-casing: ASCII that is neither a digit nor a letter.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bits of the filter that keeps words of documents without candidates from being shuffled: two megabytes, whatever the input.
FILTER_BITS = 1 << 24
RESULT = ("n_words", "n_hit", "item_ids", "n_near_items", "contaminated")


def terms(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BREAK), "")


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wid, terms, items): the distinct windows of (item_id, text) and the items that hold them."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), terms(F.col("text")).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("m", F.least(F.size("w"), F.lit(window)))
    each = items.select("item", "w", "m", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("m"))).alias("s"))
    each = each.select("item", F.slice("w", F.col("s") + 1, F.col("m")).alias("terms"))
    return each.groupBy("terms").agg(F.array_sort(F.collect_set("item")).alias("items")).select(F.xxhash64("terms").alias("wid"), "terms", "items")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, tag, n_words, words) of docs (doc_id, text), stored. tag: a hash of the text, as rows may share a doc_id."""
    split = docs.select("doc_id", F.xxhash64("text").alias("tag"), F.explode(F.array(terms(F.col("text")))).alias("words"))
    return written(split.select("doc_id", "tag", F.size("words").alias("n_words"), "words"), path)


def frequencies(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(term, df): occurrences in all documents of the vocabulary's terms."""
    return tokens.select(F.explode("words").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))


def postings(tokens: DataFrame, vocabulary: DataFrame, path: str | None = None) -> DataFrame:
    """The index: (term, doc_id, tag, positions) of the vocabulary's terms, stored as Parquet."""
    each = tokens.select("doc_id", "tag", F.posexplode("words").alias("pos", "term")).join(vocabulary, "term", "left_semi")
    return written(each.groupBy("term", "doc_id", "tag").agg(F.sort_array(F.collect_set("pos")).alias("positions")), path)


def anchored(wins: DataFrame, df: DataFrame) -> DataFrame:
    """wins with anchors: the two rarest terms and their offsets (the same one twice where there is one). Windows with an absent term go."""
    each = wins.select("wid", F.size("terms").alias("m"), F.posexplode("terms").alias("off", "term")).join(df, "term")
    each = each.groupBy("wid", "m").agg(F.sort_array(F.collect_list(F.struct("df", "term", "off"))).alias("by_df")).where(F.size("by_df") == F.col("m"))
    return wins.join(each.select("wid", F.get("by_df", F.lit(0)).alias("a"), F.coalesce(F.get("by_df", F.lit(1)), F.get("by_df", F.lit(0))).alias("b")), "wid")


def candidates(index: DataFrame, wins: DataFrame, slop: int = SLOP) -> DataFrame:
    """(doc_id, tag, wid, m, starts, near): where both anchors of a window (m words) agree, and whether they do within slop words. Windows that neither holds for have no row."""
    def starts(anchor: str) -> DataFrame:
        lists = wins.select("wid", F.size("terms").alias("m"), F.col(f"{anchor}.term").alias("term"), F.col(f"{anchor}.off").alias("off"))
        return index.join(lists, "term").select("doc_id", "tag", "wid", "m", F.transform("positions", lambda p: p - F.col("off")).alias("starts"))

    one = starts("a")
    a = one.where("m > 1")
    b = starts("b").where("m > 1").select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), F.col("wid").alias("w"), F.col("starts").alias("others"))
    both = a.join(b, a["doc_id"].eqNullSafe(b["d"]) & a["tag"].eqNullSafe(b["t"]) & (a["wid"] == b["w"]))
    agreed = F.filter(F.array_intersect("starts", "others"), lambda x: x >= 0)
    near = F.arrays_overlap(F.flatten(F.transform("starts", lambda x: F.sequence(x - slop, x + slop))), "others")
    both = both.select("doc_id", "tag", "wid", "m", agreed.alias("starts"), near.alias("near")).where("near")
    return both.unionByName(one.where("m = 1").withColumn("near", F.lit(True)))


def _covered(spans: Column) -> Column:
    """How many words lie in spans (structs of start s and end e)."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    step = lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["e"]).alias("end"))
    return F.aggregate(F.sort_array(spans), zero, step)["n"]


def _may_be_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows whose (doc_id, tag) is in keys, and few others: a bitmap of hashes is broadcast, of FILTER_BITS bits at most."""
    place = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(FILTER_BITS))
    keys = keys.select(place.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("__bits"))
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(keys), F.bitmap_bucket_number(place) == F.col("__bucket")).where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("__bucket", "__bits")


def hits(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, tag, n_hit, wids) of documents that hold windows, from candidates: each is compared with the document's words."""
    tokens = _may_be_in(tokens, found.where(F.size("starts") > 0))
    found = found.where(F.size("starts") > 0).groupBy("doc_id", "tag").agg(F.collect_list(F.struct("wid", "m", "starts")).alias("found"))
    found = found.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "found")
    same = tokens["doc_id"].eqNullSafe(found["__doc"]) & tokens["tag"].eqNullSafe(found["__tag"])
    rows = tokens.join(found, same).dropDuplicates(["__doc", "__tag"])
    real = F.transform("found", lambda c: F.struct(c["wid"].alias("wid"), c["m"].alias("m"), F.filter(c["starts"], lambda x: (c["m"] <= 2) | (F.xxhash64(F.slice("words", x + 1, c["m"])) == c["wid"])).alias("starts")))
    # A generator's output isn't copied into filters above it, so each document is judged once.
    rows = rows.select("__doc", "__tag", F.explode(F.array(F.filter(real, lambda c: F.size(c["starts"]) > 0))).alias("real")).where(F.size("real") > 0)
    spans = F.flatten(F.transform("real", lambda c: F.transform(c["starts"], lambda x: F.struct(x.alias("s"), (x + c["m"]).alias("e")))))
    return rows.select(F.col("__doc").alias("doc_id"), F.col("__tag").alias("tag"), _covered(spans).cast("bigint").alias("n_hit"), F.col("real.wid").alias("wids"))


def _with_items(rows: DataFrame, wins: DataFrame) -> DataFrame:
    """rows (doc_id, tag, wid) -> (doc_id, tag, item_ids), sorted."""
    each = rows.join(wins.select("wid", "items"), "wid").select("doc_id", "tag", F.explode("items").alias("item")).distinct()
    return each.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list("item")).alias("item_ids"))


def _found(docs: DataFrame, benchmark: DataFrame, window: int, slop: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Written: tokens, windows, candidates, hits."""
    path = shared_folder(docs.sparkSession)
    wins = written(windows(benchmark, window), f"{path}/windows")
    vocabulary = written(wins.select(F.explode("terms").alias("term")).distinct(), f"{path}/vocabulary")
    split = tokens(docs.select("doc_id", "text"), f"{path}/tokens")
    wins = written(anchored(wins, written(frequencies(split, vocabulary), f"{path}/frequencies")), f"{path}/anchored")
    rare = written(wins.select("a.term").union(wins.select("b.term")).distinct(), f"{path}/rare")
    found = written(candidates(postings(split, rare, f"{path}/postings"), wins, slop), f"{path}/candidates")
    drop(docs.sparkSession, f"{path}/postings", f"{path}/frequencies", f"{path}/rare", f"{path}/vocabulary")
    return split, wins, found, written(hits(split, found), f"{path}/hits")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20, slop: int = SLOP) -> DataFrame:
    """docs with n_words, n_hit, item_ids, n_near_items (items of which a window's rarest terms stand as in the window but for slop words) and contaminated (n_hit > 0 and share * n_hit >= n_words)."""
    split, wins, found, hit = _found(docs, benchmark, window, slop)
    near = _with_items(found.where("near").select("doc_id", "tag", "wid"), wins).withColumnRenamed("item_ids", "near_items")
    exact = _with_items(hit.select("doc_id", "tag", F.explode("wids").alias("wid")), wins)
    seen = split.select("doc_id", "tag", "n_words").distinct()
    for part in (hit.drop("wids"), exact, near):
        part = part.withColumnsRenamed({"doc_id": "__d", "tag": "__t"})
        seen = seen.join(part, seen["doc_id"].eqNullSafe(part["__d"]) & seen["tag"].eqNullSafe(part["__t"]), "left").drop("__d", "__t")
    none = F.array().cast("array<string>")
    seen = seen.select(
        F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("item_ids", none).alias("item_ids"), F.size(F.coalesce("near_items", none)).cast("bigint").alias("n_near_items"),
    )
    rest = [c for c in docs.columns if c not in RESULT]
    rows = docs.select(*rest, F.xxhash64("text").alias("__own"))
    rows = rows.join(seen, rows["doc_id"].eqNullSafe(seen["__doc"]) & rows["__own"].eqNullSafe(seen["__tag"])).select(*rest, *RESULT[:-1])
    return rows.withColumn("contaminated", _contaminated(share))


def _contaminated(share: int) -> Column:
    return (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """The documents that are not contaminated, with their own columns. Only what names contaminated ones is joined, so where these are few, no text is shuffled."""
    split, _, _, hit = _found(docs, benchmark, window, 0)
    hit = hit.select(F.col("doc_id").alias("__doc"), F.col("tag").alias("__tag"), "n_hit")
    sizes = split.select("doc_id", "tag", "n_words")
    bad = sizes.join(hit, sizes["doc_id"].eqNullSafe(hit["__doc"]) & sizes["tag"].eqNullSafe(hit["__tag"])).where(_contaminated(share))
    bad = written(bad.select("__doc", "__tag").distinct())
    same = docs["doc_id"].eqNullSafe(bad["__doc"]) & F.xxhash64(docs["text"]).eqNullSafe(bad["__tag"])
    return docs.join(bad, same, "left_anti")


def proximity(index: DataFrame, pairs: DataFrame, slop: int) -> DataFrame:
    """(item_id, doc_id, tag, pos_a, pos_b): places where terms a and b of pairs (item_id, a, b) stand at most slop words apart; both must be terms of the index. Positions are dealt by document and a grid of slop words, so no two whole lists meet."""
    index = index.select("term", "doc_id", "tag", F.explode("positions").alias("pos"))
    cell = F.floor(F.col("pos") / slop)
    a = index.join(pairs.withColumnRenamed("a", "term"), "term").select("item_id", "b", "doc_id", "tag", F.col("pos").alias("pos_a"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = index.select(F.col("term").alias("b"), "doc_id", "tag", F.col("pos").alias("pos_b"), cell.alias("cell"))
    return a.join(b, ["b", "doc_id", "tag", "cell"]).where((F.abs(F.col("pos_a") - F.col("pos_b")) <= slop) & (F.col("pos_a") != F.col("pos_b"))).select("item_id", "doc_id", "tag", "pos_a", "pos_b")
