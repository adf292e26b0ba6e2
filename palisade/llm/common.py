"""What the corpus operators share: reading tables, Arrow batches of bounded size, scratch tables, word codes."""

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.session import remove_path, scratch_path, ship_package

WORD = r"[^\x20\x09-\x0D]+"  # a word: a run of anything but the six ASCII white-space characters
GAP = r"[\x20\x09-\x0D]+"

QUERIES: dict = {}
ORACLES: dict = {}
_SCOPES: list = []

# Bytes of one Arrow batch, so that a task holds few texts at a time.
BATCH_BYTES = "4m"


def ready(spark: SparkSession) -> None:
    """Ship the package to the executors and bound Arrow batches by their bytes, as texts may be long."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with its SQL twin if there is one."""

    def register(build):
        def run(spark, sf_dir):
            ready(spark)
            return build(spark, sf_dir)

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@contextmanager
def cleaned(spark: SparkSession):
    """Remove the tables that ``stored`` writes inside, at the end; what comes out must not read them any more."""
    paths: list = []
    _SCOPES.append(paths)
    try:
        yield
    finally:
        _SCOPES.remove(paths)
        for path in paths:
            remove_path(spark, path)


def stored(df: DataFrame, name: str, outer: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it again: lineage is cut, lost executors cost nothing.

    Inside ``cleaned`` the table goes at its end; with ``outer`` at the end of the scope around it, if there is one.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    scopes = _SCOPES[:-1] if outer else _SCOPES
    if scopes:
        scopes[-1].append(path)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read.scratch = path
    return read


def discard(*frames: DataFrame) -> None:
    """Remove tables that ``stored`` wrote; their results must be stored by now."""
    for df in frames:
        remove_path(df.sparkSession, df.scratch)


def words_of(text) -> F.Column:
    """Array of the words of a text column; empty for NULL."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a variant that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text in UTF-8; splitting bytes cuts at the six ASCII white-space characters and no others."""
    return (text or "").encode().split()


class WordCodes(dict):
    """64-bit content codes of words; equal words have equal codes in every task.

    A dictionary in front of the hash. It is emptied when it holds ``most`` words, so memory stays bounded
    whatever the vocabulary; that costs time only.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (finaliser of the splitmix generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
