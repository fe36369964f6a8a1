"""Line dedup: lines whose key occurs in many documents are dropped everywhere. DataFrame operations only.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at both ends and with A-Z lower-cased. Keys are hashed
to 128 bits; each document hands over every hash once; hashes are counted with partial aggregation; the frequent ones
are joined back to the lines, and a document's flags, put in order by position, choose the lines that stay. On request
one document keeps its copy of a frequent line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import cut, free_name

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _pair(x: Column) -> Column:
    """128 bits: two 64-bit hashes of different seeds. The key of an empty line, which never counts, gets null."""
    return F.when(F.length(x) > 0, F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b")))


def lines_of(text: Column) -> Column:
    """Null counts as one empty line. split() of a Java pattern of one character takes no regular expression."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _once(ordered: Column) -> Column:
    """Distinct entries of a sorted array, in one pass; array_distinct() compares all pairs of structs."""
    before = F.concat(F.array(F.lit(None).cast("struct<a:bigint,b:bigint>")), F.slice(ordered, F.lit(1), F.size(ordered) - 1))
    return F.array_compact(F.zip_with(ordered, before, lambda x, y: F.when(~x.eqNullSafe(y), x)))


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, key: str = "doc_id", text: str = "text", keep_one: bool = False) -> DataFrame:
    """docs, with `text` reduced to the lines that stay (joined by \\n), plus `n_lines` and `n_dropped` (long).

    A key of at least min_chars code points in at least min_docs documents loses all its lines. A row is a document
    unless another row has the same key and the same text: such repeated rows count as one document, and each of them
    comes back. A null text is one empty line and comes back as an empty text; null keys are a value like any other. A
    document that loses all its lines keeps its row, with an empty text. If docs has columns n_lines or n_dropped, the
    new ones get underscores in front; all other columns pass through.

    keep_one: a frequent line stays in the documents with the least key that hold it (null keys come last, and documents
    that share a key all keep it), so that of texts with many copies one is left whole and nothing is lost altogether.

    Shuffles: hashes of lines (20 bytes a line) by hash and by document, and the documents once. A frequent line is
    pre-aggregated before its shuffle; in the join its rows lie on the side that adaptive execution splits.
    """
    n_lines, n_dropped, k = free_name(docs, "n_lines"), free_name(docs, "n_dropped"), free_name(docs, "_k")
    keyed = lambda d: d.withColumn(k, F.struct(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("\x00"))).alias("a"), F.xxhash64(F.lit(3), F.col(text)).alias("b"), F.xxhash64(F.col(text)).alias("c")))
    keys = F.transform(lines_of(F.col(text)), line_key)
    hashes = keyed(docs.select(key, text)).select(F.col(k).alias("_k"), F.col(key).alias("_id"), F.transform(keys, lambda x: F.when(F.length(x) >= max(1, min_chars), _pair(x))).alias("_h"))
    hashes = cut(hashes.groupBy("_k").agg(F.first("_h").alias("_h"), *[F.first("_id").alias("_id")] * keep_one))  # read twice below
    own = ["_id"] * keep_one
    lines = hashes.select("_k", *own, F.posexplode("_h").alias("_at", "_hash")).where("_hash is not null")
    counted = hashes.select(*own, F.explode(_once(F.sort_array("_h"))).alias("_hash")).where("_hash is not null").groupBy("_hash")
    frequent = counted.agg(F.count("*").alias("count"), *[F.min("_id").alias("_keeper")] * keep_one).where(F.col("count") >= min_docs)
    frequent = cut(frequent.drop("count"))
    found = lines.join(frequent, "_hash").where(~F.col("_id").eqNullSafe(F.col("_keeper"))) if keep_one else lines.join(frequent, "_hash", "left_semi")
    dropped = found.groupBy("_k").agg(F.array_sort(F.collect_list("_at")).alias("_gone"))
    gone = free_name(docs, "_gone")
    joined = keyed(docs).join(dropped.toDF(k, gone), k, "left")
    return _reassemble(joined, text, n_lines, n_dropped, gone).select(*docs.columns, n_lines, n_dropped)


def _reassemble(df: DataFrame, text: str, n_lines: str, n_dropped: str, gone: str) -> DataFrame:
    """Lines at the positions `gone`, sorted, are left out. The runs between them are cut out with slice(), so that the
    work is one copy of the lines, however many go."""
    name = free_name(df, "_lines")
    lines = F.col(name)
    df = df.withColumn(name, lines_of(F.col(text))).withColumn(gone, F.coalesce(gone, F.array().cast("array<int>")))
    starts = F.concat(F.array(F.lit(-1)), F.col(gone))
    ends = F.concat(F.col(gone), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1)))
    return df.withColumns({
        n_lines: F.size(lines).cast("long"),
        n_dropped: F.size(gone).cast("long"),
        text: F.when(F.size(gone) == 0, F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(kept, "\n")),
    })
