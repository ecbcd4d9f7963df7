"""Token counts: the pieces of every distinct pre-token once, met with the pre-tokens of each document."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.base import AT_ONCE, Kept, key_and_text, texts_of
from tidemark.llm.bpe import ByteBpe, loaded, shipped

#: The most frequent pre-tokens of a sample go to every task; the bounds hold whatever the data's size.
COMMON, SAMPLE = 1 << 18, 4000
#: Distinct pre-tokens a task gathers before it hands them on.
GATHERED = 300_000


class Cutter:
    """Cuts texts into pre-tokens and adds up the pieces of known ones; the others are left to a join."""

    def __init__(self, bpe: ByteBpe, known: dict[str, int]):
        self.bpe, self.known = bpe, known
        self.parts: Kept = Kept()  # of a piece of text: pieces of its known pre-tokens, its other pre-tokens

    def of(self, piece: str) -> tuple[int, tuple[str, ...]]:
        if (parts := self.parts.known(piece)) is None:
            words = self.bpe.pre_tokens(piece)
            parts = sum(self.known.get(w, 0) for w in words), tuple(w for w in words if w not in self.known)
            self.parts.keep(piece, parts)
        return parts

    def count(self, text: str) -> tuple[int, dict[str, int]]:
        """Pieces of the known pre-tokens and the added tokens; how often each other pre-token occurs."""
        total, rest = 0, {}
        for part, added in self.bpe.plain_parts(text):
            if added is not None:
                total += 1
                continue
            for piece, n in Counter(self.bpe.cut(part)).items():
                sure, others = self.of(piece)
                total += n * sure
                for w in others:
                    rest[w] = rest.get(w, 0) + n
        return total, rest


def frequencies(docs: DataFrame, path: str) -> DataFrame:
    """Every distinct pre-token of the texts (column text) and how often it occurs."""
    spec = shipped(docs, path)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, total = Cutter(loaded(spec), {}), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([*total], pa.string()), pa.array([*total.values()], pa.int64())], names=["token", "n"])
        for batch in batches:
            for text in texts_of(batch.column(0)):
                for w, n in cutter.count(text)[1].items():
                    total[w] += n
                if len(total) > GATHERED:
                    yield out()
                    total.clear()
        if total:
            yield out()

    return docs.select("text").mapInArrow(gather, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _pieces(spec):
    """From rows ordered by token: the pieces of each token, made once for all rows of it, times n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, int] = {}  # of the token that may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = batch.column(0).dictionary_encode()
            words = coded.dictionary.to_pylist()
            new = [w for w in words if w not in last and w]
            counts = last | dict(zip(new, (len(x) // 4 for x in loaded(spec).encode_words(new)), strict=True)) if new else dict(last)
            counts[""] = -1  # the rows that stand for documents
            each = np.array([counts[w] for w in words], np.int64)[coded.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(each)], names=["_key", "_hash", "n", "pieces"])
            last = {words[-1]: counts[words[-1]]}

    return run


def count(df: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text", common: int = COMMON, sample: int = SAMPLE) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens, over_limit of every text; no ids are made.

    Texts are cut once.  Pre-tokens are counted in pieces once each: those `common` in a sample of about `sample` rows
    are sent to the scan, which sums them in place; the rows (document, pre-token, frequency) of all others meet by
    pre-token, get its pieces and are summed by document.  Any sample and any `common` give the same sums.  One row per
    input row, repeated rows too; a null text is empty and has no tokens.  Strings of added tokens count as one token.
    Only key and text are read.
    """
    docs = key_and_text(df, key, text).withColumnRenamed(key, "_key")
    spec, rows = shipped(df, path), max(1, docs.count())
    few = frequencies(docs.sample(min(1.0, sample / rows), seed=1), path).orderBy(F.desc("n"), "token").limit(common)
    words = [r["token"] for r in few.select("token").collect()]  # at most what the sample holds
    pieces = [len(x) // 4 for x in loaded(spec).encode_words(words)] if words else []
    head = df.sparkSession.sparkContext.broadcast(dict(zip(words, pieces, strict=True)))
    schema = T.StructType([
        T.StructField("_key", docs.schema["_key"].dataType), T.StructField("_hash", T.LongType()), T.StructField("n_bytes", T.LongType()),
        T.StructField("summed", T.LongType()), T.StructField("rest", T.MapType(T.StringType(), T.LongType()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(loaded(spec), head.value)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                texts = texts_of(part.column(2))
                found = [cutter.count(t) for t in texts]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array([x[0] for x in found], pa.int64()),
                    pa.array([[*x[1].items()] for x in found], pa.map_(pa.string(), pa.int64()))], names=schema.fieldNames())

    # Rows are told apart by their key, and by a hash of the text too where keys repeat: it alone would be a third of what
    # is shuffled.  Only keys are read for this.
    repeated = not docs.groupBy("_key").count().where("count > 1").isEmpty()
    own = F.xxhash64("text") if repeated else F.lit(0).cast("long")
    cut = docs.select("_key", own.alias("_hash"), "text").mapInArrow(scan, schema)
    # Two rows without a token stand for the document, with its sum and with its size (as -1 - size): the rows that are
    # shuffled stay narrow.  Repeated rows are counted by them.
    rest = F.transform(F.map_entries("rest"), lambda x: F.struct(x["key"].alias("token"), x["value"].alias("n")))
    own = F.array(F.struct(F.lit("").alias("token"), F.col("summed").alias("n")), F.struct(F.lit("").alias("token"), (-1 - F.col("n_bytes")).alias("n")))
    marked = cut.select("_key", "_hash", F.explode(F.concat(own, rest)).alias("x")).select("x.token", "_key", "_hash", "x.n")
    # The rows of a pre-token meet, those that stand for documents don't.
    met = marked.repartition(F.when(F.col("token") == "", F.xxhash64("_key", "_hash")).otherwise(F.xxhash64("token"))).sortWithinPartitions("token")
    counted = met.mapInArrow(_pieces(spec), T.StructType([*(marked.schema[c] for c in ("_key", "_hash", "n")), T.StructField("pieces", T.LongType())]))
    of_sum, of_size = (F.col("pieces") < 0) & (F.col("n") >= 0), F.col("n") < 0
    total = counted.groupBy("_key", "_hash").agg(
        F.sum(of_sum.cast("long")).alias("rows"), F.max(F.when(of_size, -1 - F.col("n"))).alias("n_bytes"), F.max(F.when(of_sum, F.col("n"))).alias("summed"),
        F.sum(F.when(F.col("pieces") >= 0, F.col("n") * F.col("pieces")).otherwise(0)).alias("more"))
    tokens = F.col("summed") + F.col("more") / F.col("rows")
    out = total.select(F.col("_key").alias(key), "n_bytes", tokens.cast("long").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return out.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
