"""A stored index of character trigrams with positions, for literal substring search.

``grams`` has a row for each trigram of a text in lower case, with the places where it begins, folded to the
64 bits of a mask (place modulo 64); texts are padded, so every character begins a trigram. ``counts``
adds up how many texts have a trigram. A needle is looked up by its rarest trigrams: their masks, each
turned by the trigram's place in the needle, must share a bit, or the needle is not there. Only texts that
pass are read and searched. A needle of one or two characters is the begin of trigrams, and texts that have
one contain it; an empty needle is in every text that is not null.

Changes are generations, as of ``textindex``: valid once ``sizes`` is written; deletions hide older
generations, so ids may come back. Letters' case is folded as the JVM's ``lower`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.batches import large_texts, map_batches
from quarry.operators.retrieval import top_k
from quarry.session import kept

BUCKETS = 16
Q = 3
PAD = "\x00"
#: Trigrams of a needle that are looked up, rarest first.
LOOKED_UP = 4
GRAMS = "id bigint, gram string, places bigint"


def grams_of(texts: DataFrame) -> DataFrame:
    """``GRAMS`` of texts (id, low)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def of(part: pa.RecordBatch) -> pa.RecordBatch:
            ids, grams, places = [], [], []
            for key, text in zip(part.column(0).to_pylist(), large_texts(part.column(1)).to_pylist()):
                code = np.frombuffer((text + PAD * (Q - 1)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
                if len(code) < Q:
                    continue
                packed = (code[:-2] << 42) | (code[1:-1] << 21) | code[2:]
                found, which = np.unique(packed, return_inverse=True)
                mask = np.zeros(len(found), dtype=np.uint64)
                np.bitwise_or.at(mask, which, np.uint64(1) << (np.arange(len(packed)) % 64).astype(np.uint64))
                ids.append(np.full(len(found), key))
                grams += [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in found.tolist()]
                places.append(mask.view(np.int64))
            flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64), pa.int64())
            return pa.RecordBatch.from_arrays([flat(ids), pa.array(grams, pa.string()), flat(places)], names=["id", "gram", "places"])

        return of

    return map_batches(texts.select("id", "low"), ["id", "low"], GRAMS, make, slice_rows=64, slice_bytes=1 << 20)


@dataclass(frozen=True)
class GramIndex:
    """An index below a folder; ids that are there and not deleted must not be appended again."""

    spark: SparkSession
    folder: str

    @classmethod
    def build(cls, corpus: DataFrame, folder: str) -> GramIndex:
        """From ``corpus`` (id, text)."""
        return cls(corpus.sparkSession, folder).append(corpus)

    def _generations(self, part: str) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{part}")
        files = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("gen="))

    def _next(self) -> int:
        return 1 + max([g for part in ("texts", "gone", "sizes") for g in self._generations(part)], default=0)

    def _read(self, part: str, schema: str) -> DataFrame:
        valid = sorted(set(self._generations("sizes")) & set(self._generations(part)))
        if not valid:
            return self.spark.createDataFrame([], f"{schema}, gen int")
        return self.spark.read.schema(f"{schema}, gen int").parquet(f"{self.folder}/{part}").filter(F.col("gen").isin(valid))

    def _write(self, rows: DataFrame, part: str, gen: int, *by: str) -> None:
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{self.folder}/{part}/gen={gen}")

    def append(self, new: DataFrame) -> GramIndex:
        """Texts of ids that are not there; null texts have no trigrams and are never found."""
        gen = self._next()
        rows = new.select(F.col("id").cast("long").alias("id"), F.lower("text").alias("low")).filter("low is not null")
        self._write(rows, "texts", gen)
        texts = self.spark.read.schema("id bigint, low string").parquet(f"{self.folder}/texts/gen={gen}")
        grams = grams_of(texts).withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).cast("int"))
        # a frequent trigram's rows are dealt to several tasks
        dealt = grams.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram", "id")
        self._write(dealt, "grams", gen, "bucket")
        written = self.spark.read.schema(f"{GRAMS}, bucket int").parquet(f"{self.folder}/grams/gen={gen}")
        self._write(written.groupBy("gram").agg(F.count("*").alias("n")), "counts", gen)
        self._write(texts.agg(F.count("*").alias("n")), "sizes", gen)
        return self

    def delete(self, ids: DataFrame) -> GramIndex:
        """Hide texts. Counts of trigrams stay, as they only choose which are looked up."""
        gen = self._next()
        self._write(ids.select(F.col("id").cast("long").alias("id")).distinct(), "gone", gen)
        self._write(self.spark.range(1).select(F.lit(0).cast("long").alias("n")), "sizes", gen)
        return self

    def _live(self, rows: DataFrame) -> DataFrame:
        if not self._generations("gone"):
            return rows
        gone = self._read("gone", "id bigint").groupBy("id").agg(F.max("gen").alias("_gone"))
        return rows.join(gone, "id", "left").filter(F.col("_gone").isNull() | (F.col("_gone") < F.col("gen"))).drop("_gone")

    def _candidates(self, needles: list[tuple[int, str]]) -> DataFrame:
        """(needle, id, gen, sure): texts that may contain a needle, or do."""
        counts = self._read("counts", "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
        long = [(i, low[at : at + Q], at) for i, low in needles if len(low) >= Q for at in range(len(low) - Q + 1)]
        short = [(i, low) for i, low in needles if 0 < len(low) < Q]
        asked = self.spark.createDataFrame(long, "needle int, gram string, at int").groupBy("needle", "gram").agg(F.min("at").alias("at"))
        # a trigram that no text has leaves its needle without candidates
        ranked = top_k(asked.join(counts, "gram", "left"), ["needle"], [F.asc_nulls_first("n"), F.asc("at")], LOOKED_UP)
        chosen = kept(ranked.select("needle", "gram", "at"))
        begins = self.spark.createDataFrame(short, "needle int, begin string").join(counts, F.col("gram").startswith(F.col("begin"))).select("needle", "gram", F.lit(-1).alias("at"))
        wanted = kept(chosen.unionByName(begins))  # a row a looked-up trigram of a needle
        buckets = [r["b"] for r in wanted.select(F.pmod(F.xxhash64("gram"), F.lit(BUCKETS)).alias("b")).distinct().collect()]
        rows = self._read("grams", f"{GRAMS}, bucket int").filter(F.col("bucket").isin(buckets))
        met = rows.join(F.broadcast(wanted) if wanted.count() <= 10_000 else wanted, "gram")
        # turned so that the needle's own begin is at the bit: right by ``at``, around
        turn = F.col("at") % 64
        turned = F.expr("(shiftrightunsigned(places, at % 64) | shiftleft(places, (64 - at % 64) % 64))")
        both = met.withColumn("begins", F.when(turn <= 0, F.col("places")).otherwise(turned))
        each = both.groupBy("needle", "id", "gen").agg(F.count("*").alias("n"), F.bit_and("begins").alias("begins"), F.max(F.col("at") < 0).alias("sure"))
        need = chosen.groupBy("needle").agg(F.count("*").alias("need"))
        joined = each.join(F.broadcast(need), "needle", "left")
        return joined.filter(F.col("sure") | ((F.col("n") == F.col("need")) & (F.col("begins") != 0))).select("needle", "id", "gen", "sure")

    def search(self, needles: Sequence[str], reads: bool = False) -> DataFrame:
        """(id, needle) of every text and each of ``needles`` that it contains, letters' case aside; ``reads``
        adds how many texts were read for a needle."""
        lows = [r["l"] for r in self.spark.createDataFrame([(i, n) for i, n in enumerate(needles)], "i int, n string").select("i", F.lower("n").alias("l")).orderBy("i").collect()]
        named = self.spark.createDataFrame([(i, n, low) for i, (n, low) in enumerate(zip(needles, lows, strict=True))], "needle int, name string, low_needle string")
        texts = self._read("texts", "id bigint, low string")
        found = kept(self._live(self._candidates(list(enumerate(lows)))))
        named = F.broadcast(named)  # a row a needle of the caller
        sure = found.filter("sure").select("needle", "id", F.lit(0).alias("read"))
        doubtful = found.filter("not sure").join(named, "needle").join(texts, ["id", "gen"])
        checked = doubtful.filter(F.contains("low", F.col("low_needle"))).select("needle", "id", F.lit(1).alias("read"))
        out = sure.unionByName(checked)
        if "" in lows:
            empty = self._live(texts).join(named.filter("low_needle = ''"), F.lit(True)).select("needle", "id", F.lit(0).alias("read"))
            out = out.unionByName(empty)
        hits = out.join(named, "needle").select("id", F.col("name").alias("needle"), F.col("needle").alias("_i"))
        if not reads:
            return hits.drop("_i")
        read = found.groupBy("needle").agg(F.count_if(~F.col("sure")).alias("texts_read")).withColumnRenamed("needle", "_i")
        return hits.join(read, "_i", "left").drop("_i").withColumn("texts_read", F.coalesce("texts_read", F.lit(0)))
