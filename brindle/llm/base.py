"""Common plumbing of the corpus operators.

Conventions, the same for every operator unless its docstring says otherwise: a null text counts
as an empty text; an operator reads only the columns it names, so extra columns never clash; rows
with equal ids are separate rows; an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.session import discard, materialise, shared_dir  # noqa: F401  (re-exported)

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZERS = os.environ.get("BRINDLE_TOKENIZERS", "/opt/tokenizers")


def ship(spark: SparkSession, batch_mb: int = 4) -> None:
    """Give the executors this package once a session, wherever they run, and keep the batches that Python workers get small
    in bytes (until the next call tells another size), so that very long texts don't add up. Spark drops a job's shuffle files when the job has ended."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(batch_mb << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5000")
    sc = spark.sparkContext
    if getattr(sc, "_brindle_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="brindle-zip-")) / "brindle_pkg.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._brindle_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def temp_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    have = {c.lower() for c in df.columns}
    while stem.lower() in have:
        stem += "_"
    return stem


def hash_fraction(col, seed: int):
    """Uniform number in [0, 1) that depends on the value and seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), col), 11) / F.lit(float(1 << 53))).cast("double")


def np_mix_ids(ids: np.ndarray, seed: int) -> np.ndarray:
    from brindle.llm.textvec import mix

    with np.errstate(over="ignore"):
        return mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.uint64(seed + 1)))


def row_keys(ids, texts: list[str], seed: int) -> np.ndarray:
    """A 64-bit key of each row, from its id, or from its text where it has none."""
    out = np_mix_ids(ids.fillna(-1).to_numpy(np.int64), seed)
    for i in np.flatnonzero(ids.isna().to_numpy()):
        out[i] = xxhash.xxh3_64_intdigest(texts[i].encode("utf-8", "surrogatepass"), seed)
    return out


def vocabulary_file(spark: SparkSession, path: str) -> str:
    """Ship a tokenizer's file to the executors once; gives the name under which ``local_vocabulary`` finds it there."""
    sc = spark.sparkContext
    sent = getattr(sc, "_brindle_files", None)
    if sent is None:
        sent = sc._brindle_files = set()
    if path not in sent:
        sc.addFile(path)
        sent.add(path)
    return os.path.basename(path)


def local_vocabulary(name: str) -> str:
    return SparkFiles.get(name)


FILTER_BITS = 1 << 22


def bit_filter(hashes: DataFrame) -> np.ndarray | None:
    """A set of the 64-bit ``hashes`` (one column) as a fixed 4 million bits, or None for the empty set. What isn't in it surely isn't among the hashes; the
    rest must go through an exact join. It reaches the driver as 65,536 words at most, whatever the size of the set."""
    (c,) = hashes.columns
    at = F.pmod(F.col(c), F.lit(FILTER_BITS))
    rows = hashes.select(F.shiftright(at, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod({c}, 64) as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).collect()
    if not rows:
        return None
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for r in rows:
        words[r["w"]] = r["b"]
    return words


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the int64 or uint64 ``hashes`` the filter may hold."""
    h = hashes.view(np.uint64)
    return ((words.view(np.uint64)[(h % np.uint64(FILTER_BITS)) >> np.uint64(6)] >> (h & np.uint64(63))) & np.uint64(1)).astype(bool)


def materialise_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` to the shared folder in ``buckets`` files by the hash of ``key``: work that needs the rows of a key together reads them without
    another shuffle. The catalog only knows the table until it has been read back."""
    spark = df.sparkSession
    tag = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{tag}").saveAsTable(tag)
    back = spark.table(tag)
    spark.sql(f"DROP TABLE {tag}")
    return back
