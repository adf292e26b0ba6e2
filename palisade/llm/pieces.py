"""Sentence pieces: unigram Viterbi over a double-array trie of scored pieces, with byte fallback, and back.

The vocabulary comes from a piece model file; it is not trained. As that file orders its pieces by a merge rank, a
piece of rank r gets the log score -ln(r) - ln(H), a Zipf law over the ranks (``scores="rank"``); ``scores="model"``
takes the file's own scores, for files of the unigram kind. A character without a piece of its own may be written as
the byte pieces of its UTF-8 form, at the lowest score less ten.

A space is the white-space marker of the pieces, and one is put in front of every text that is not empty. A marker
character that stands in the text itself is written in bytes, so decoding gives the text back exactly, whatever it
holds. NULL and empty texts have no pieces and decode to the empty text. Rows are encoded one by one: repeated rows
alike, an empty table to an empty table. Extra columns stay; result names that clash get a trailing underscore.
"""

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from palisade.llm.common import free_name, query, table

MARKER = "▁"
SEGMENT = re.compile(r"\n|\x20+[^\x20\n]*|[^\x20\n]+")
PENALTY = 10.0
_BUILT: dict = {}


class DoubleArray:
    """A trie in two arrays: the child of state s by byte c is base[s] + c + 1 if check there says s."""

    def __init__(self, keys: dict[bytes, int]):
        root: dict = {}
        for key, value in keys.items():
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = value
        size = 64 * sum(map(len, keys)) + 1024
        used = bytearray(size)
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0], used[0] = 0, 1
        # Nodes with one child fill the holes from the left; the others are laid out one behind the other.
        todo, hole, wide = [(0, root)], 300, 300
        while todo:
            state, node = todo.pop()
            if -1 in node:
                value[state] = node[-1]
            codes = sorted(c for c in node if c >= 0)
            if not codes:
                continue
            slot = used.find(0, hole if len(codes) == 1 else wide)
            while any(used[slot + c - codes[0]] for c in codes):
                slot = used.find(0, slot + 1)
            hole, wide = (slot, wide) if len(codes) == 1 else (hole, slot)
            at = slot - codes[0] - 1
            base[state] = at
            for c in codes:
                check[at + c + 1], used[at + c + 1] = state, 1
            todo += [(at + c + 1, node[c]) for c in codes]
        end = int(np.nonzero(check >= 0)[0].max()) + 258
        self.base, self.check, self.value = base[:end], check[:end], value[:end]


class PieceModel:
    """Pieces, scores and the trie; small enough to be sent to every task (a few arrays per piece)."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: dict[int, int]):
        """``byte_ids``: byte value to id of its piece. Pieces with score None are control pieces and never match."""
        self.byte_ids = [byte_ids[b] for b in range(256)]
        spoken = {i: p.replace(MARKER, " ").encode() for i, p in enumerate(pieces) if scores[i] is not None}
        self.scores = [0.0 if s is None else float(s) for s in scores]
        self.unknown = min(self.scores[i] for i in spoken) - PENALTY
        trie = DoubleArray({key: i for i, key in spoken.items()})
        self.base, self.check, self.value = trie.base.tolist(), trie.check.tolist(), trie.value.tolist()
        self.bytes = [spoken.get(i, b"") for i in range(len(pieces))]
        for b, i in byte_ids.items():
            self.bytes[i] = bytes([b])
        # Pieces that hold a marker behind another character, or a newline, would cross the cuts of SEGMENT.
        self.cut = not any(b" " in k.lstrip(b" ") or (b"\n" in k and k != b"\n") for k in spoken.values())

    def best(self, data: bytes) -> list[int]:
        """Ids on the best path through the pieces of ``data``."""
        n, base, check, value, scores = len(data), self.base, self.check, self.value, self.scores
        best, back, piece = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], i = 0.0, 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, j, alone = best[i], 0, i, False
            while j < n:
                nxt = base[state] + data[j] + 1
                if check[nxt] != state:
                    break
                state, j = nxt, j + 1
                v = value[state]
                if v >= 0:
                    score = here + scores[v]
                    if score > best[j]:
                        best[j], back[j], piece[j] = score, i, v
                    alone = alone or j - i == width
            if not alone and here + self.unknown > best[i + width]:
                best[i + width], back[i + width], piece[i + width] = here + self.unknown, i, -1
            i += width
        out: list[int] = []
        while n:
            start = back[n]
            out += [piece[n]] if piece[n] >= 0 else [self.byte_ids[b] for b in reversed(data[start:n])]
            n = start
        return out[::-1]


def load_model(path: str, scores: str = "rank") -> PieceModel:
    """A piece model file of the sentencepiece library; ``scores``: "rank" or "model"."""
    import sentencepiece

    if (path, scores) in _BUILT:
        return _BUILT[path, scores]
    file = sentencepiece.SentencePieceProcessor(model_file=path)
    n = file.get_piece_size()
    pieces = [file.id_to_piece(i) for i in range(n)]
    byte_ids = {int(pieces[i][3:5], 16): i for i in range(n) if file.is_byte(i)}
    normal = [i for i in range(n) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i) or file.is_unused(i))]
    total = float(np.log(np.sum(1.0 / np.arange(1, len(normal) + 1))))
    given: list = [None] * n
    for rank, i in enumerate(normal, 1):
        given[i] = file.get_score(i) if scores == "model" else -float(np.log(rank)) - total
    _BUILT[path, scores] = PieceModel(pieces, given, byte_ids)
    return _BUILT[path, scores]


class Speaker:
    """Encodes and decodes texts in one task; segments seen before come from a dictionary of bounded size."""

    def __init__(self, model: PieceModel, most: int = 300_000, longest: int = 64):
        self.model, self.most, self.longest, self.known = model, most, longest, {}

    def segment(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = np.array(self.model.best(part.encode()), np.int32).tobytes()
            if len(part) <= self.longest:
                if len(self.known) >= self.most:
                    self.known.clear()
                self.known[part] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        parts = SEGMENT.findall(" " + text) if self.model.cut else [" " + text]
        return np.frombuffer(b"".join(map(self.segment, parts)), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.model.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return raw.removeprefix(" ")


def speaker(model) -> Speaker:
    """One speaker for each worker process and broadcast model."""
    if model.id not in _BUILT:
        _BUILT[model.id] = Speaker(model.value)
    return _BUILT[model.id]


class Shared:
    """A broadcast value with an id that workers can remember it by."""

    def __init__(self, spark, value):
        self.sent = spark.sparkContext.broadcast(value)
        self.id = ("model", spark.sparkContext.applicationId, self.sent._jbroadcast.id())

    def __getstate__(self):
        return {"sent": self.sent, "id": self.id}

    @property
    def value(self):
        return self.sent.value


def encoded(docs: DataFrame, model: PieceModel, text: str = "text", out: str = "piece_ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>."""
    shared, name = Shared(docs.sparkSession, model), free_name(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    at = docs.columns.index(text)

    def run(batches):
        say = speaker(shared)
        for batch in batches:
            ids = [say.encode(t or "") for t in batch.column(at).to_pylist()]
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
            yield pa.record_batch([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(flat))], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def decoded(docs: DataFrame, model: PieceModel, ids: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the text of each id list."""
    shared, name = Shared(docs.sparkSession, model), free_name(docs, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType())])
    at = docs.columns.index(ids)

    def run(batches):
        say = speaker(shared)
        for batch in batches:
            lists = batch.column(at)
            texts = [say.decode(x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32)) for x in lists]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)


def checked(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """``docs`` with piece_ids and whether they decode to the text."""
    ids, back, same = (free_name(docs, c) for c in ("piece_ids", "decoded", "round_trip"))
    done = decoded(encoded(docs, model, text, ids), model, ids, back)
    return done.withColumn(same, F.col(back) == F.coalesce(F.col(f"`{text}`"), F.lit(""))).drop(back)


def crc_of(ids):
    @F.pandas_udf("long")
    def crc(lists):
        return lists.map(lambda x: zlib.crc32(np.asarray(x, "<u4").tobytes()))

    return crc(ids)


@query("op7_sentencepiece")
def op7(spark, sf_dir):
    """Piece ids of every text and the way back: numbers, digests of ids and decoded text, and whether it is the text."""
    import public_tokenizers

    model = load_model(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = decoded(encoded(docs, model), model)
    first, last = min(model.byte_ids), max(model.byte_ids)
    return done.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"),
        F.size(F.filter("piece_ids", lambda i: i.between(first, last))).cast("long").alias("n_byte_pieces"),
        crc_of(F.col("piece_ids")).alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )
