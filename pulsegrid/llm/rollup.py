"""Token counts kept as additive rollups: signed changes in, totals by source, language and tokenizer
version out, each batch committed once however often it is sent."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import cut, texts
from pulsegrid.llm.packing import word_tokens

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, docs long, tokens long"


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Tokens of every row of ``docs`` (doc_id, text, source, lang): rows (doc_id, source, lang, th,
    words, tokens), th the 64-bit hash of the text. Null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer)
        for batch in batches:
            words, tokens = [], []
            for text, ids in zip(texts(batch.column("text")), encode.all(texts(batch.column("text")))):
                words.append(len(text.split()))
                tokens.append(len(ids))
            names = ["doc_id", "source", "lang", "th", "words", "tokens"]
            yield pa.record_batch(
                [*(batch.column(c) for c in names[:4]), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=names,
            )

    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
        F.xxhash64("text").alias("th"),
    )
    return picked.mapInArrow(
        run, "doc_id long, source string, lang string, th long, words long, tokens long"
    )


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums of ``changes`` (op, source, lang, tokenizer, tokens, old_tokens): an insert adds a
    document and its tokens, a delete takes them away, a revision adds the difference of the counts.
    Null keys are groups of their own, null counts are zero; another op is an error. One partial sum
    per task leaves the map side, so a source with a third of all rows is no hot key."""
    op = F.lower("op")
    sign = (
        F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0)
        .otherwise(F.raise_error(F.concat(F.lit("no such change: "), F.coalesce(F.col("op"), F.lit("null")))))
    )
    new, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    amount = F.when(op == "revise", new - old).otherwise(sign * new)
    return (
        changes.groupBy(*KEYS)
        .agg(F.sum(sign).cast("long").alias("docs"), F.sum(amount).cast("long").alias("tokens"))
        .where("docs <> 0 or tokens <> 0")
    )


class Rollup:
    """Totals below a folder of the shared storage, one sub-folder of deltas per batch."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _exists(self, path: str) -> bool:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place)

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch, once: False if it is committed already. The marker that Spark writes when all
        tasks are done is the commit; what an interrupted attempt left is overwritten."""
        target = f"{self.path}/batch={batch}"
        if self._exists(f"{target}/_SUCCESS"):
            return False
        deltas(changes).write.mode("overwrite").parquet(target)
        return True

    def committed(self, batches: list[str]) -> list[str]:
        return [b for b in batches if self._exists(f"{self.path}/batch={b}/_SUCCESS")]

    def totals(self, batches: list[str]) -> DataFrame:
        """Documents and tokens by source, language and tokenizer over the committed ones of
        ``batches``; keys whose documents are all gone are left out. No batch: no rows."""
        paths = [f"{self.path}/batch={b}" for b in self.committed(batches)]
        rows = (
            self.spark.read.schema(DELTAS).parquet(*paths)
            if paths else self.spark.createDataFrame([], DELTAS)
        )
        return (
            rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
            .where("docs <> 0")
        )


def changes(counts: DataFrame, op: str) -> DataFrame:
    """``op`` changes of ``token_counts`` rows: version words-1 is the count of words, word_bpe_49k
    that of tokens. A revision of the latter counts the end of the text as well."""
    both = F.array(
        F.struct(F.lit("words-1").alias("tokenizer"), F.col("words").alias("tokens")),
        F.struct(F.lit("word_bpe_49k").alias("tokenizer"), F.col("tokens").alias("tokens")),
    )
    rows = counts.select("source", "lang", F.explode(both).alias("c"), F.lit(op).alias("op")).select(
        "op", "source", "lang", "c.*"
    )
    if op == "revise":
        rows = rows.where("tokenizer = 'word_bpe_49k'")
        return rows.withColumn("old_tokens", F.col("tokens")).withColumn("tokens", F.col("tokens") + 1)
    return rows.withColumn("old_tokens", F.lit(None).cast("long"))


def later_copies(counts: DataFrame) -> DataFrame:
    """Rows of ``token_counts`` whose text stands under a smaller doc_id as well."""
    least = counts.groupBy("th").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return counts.join(least.select("th", "least"), "th").where("doc_id > least").drop("least")


def replayed(docs: DataFrame, path: str, parts: int = 4) -> DataFrame:
    """Totals of a feed made of all rows of ``docs``, kept below ``path``: inserts in ``parts``
    batches, deletion of later copies of a text, a revision of the counts of what is left; the first
    insert and the deletion are sent twice, as after a lost answer."""
    counts = cut(token_counts(docs), "token-counts")
    gone = cut(later_copies(counts), "later-copies")
    table = Rollup(docs.sparkSession, path)
    part = F.pmod(F.xxhash64("doc_id", "th"), F.lit(parts))
    first = [(f"insert-{k}", changes(counts.where(part == k), "insert")) for k in range(parts)]
    left = counts.join(gone.select("doc_id", "th").distinct(), ["doc_id", "th"], "left_anti")
    feed = [*first, ("delete-0", changes(gone, "delete")), first[0], ("delete-0", changes(gone, "delete"))]
    feed.append(("revise-0", changes(left, "revise")))
    for name, rows in feed:
        table.commit(name, rows)
    return table.totals(list(dict(feed)))
