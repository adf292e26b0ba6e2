"""Token ids of all documents in Arrow stream files of equal-length sequences.

A file is an Arrow IPC stream. Every record batch but the last has ``rows_per_batch`` rows; a row is one sequence:

- ``ids``: fixed-size list of ``length`` token ids (16-bit when the vocabulary allows, else 32-bit),
- ``mask``: fixed-size list of ``length`` booleans, false only on the padding at the end of a file,
- ``doc_ids``, ``doc_starts``, ``doc_lengths``: the documents that begin in the sequence, with their place in the file
  and their number of tokens, end id included.

Buffers are not compressed, so a memory-mapped file gives sequence ``n`` as a view: batch ``n // rows_per_batch``, row
``n % rows_per_batch`` (``TokenFile``). Files are numbered in ascending order of doc_id and cover consecutive ranges of
it. A task writes to a name of its own and renames at the end; a repeated task replaces its file by the same bytes.

NULL texts count as empty and hold only the end id; a NULL doc_id sorts first; rows with the same doc_id are ordered
by their text. An empty table gives no files and no rows. Columns other than the two named ones are not stored.
"""

import os
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from palisade.llm.common import query, table
from palisade.session import scratch_path

LENGTH, ROWS_PER_BATCH, END_ID = 2048, 64, 1
SPACE, SEPARATOR = re.compile(r"[^ \t\n\r]+"), re.compile("[\x1c-\x1f]")
MARKS = ".,!?;:"
JOINT, JOINED = " . ", 256  # between words of letters that are encoded in one text, and the most of them
_LOADED: dict = {}


class Encoder:
    """Token ids of texts as little-endian bytes, encoded by the tokenizers library.

    For a tokenizer that lower-cases and drops white space (``by_word``) the ids of a text are those of its words, and
    those of a word are the ids of its letters and of the marks behind them. What was seen before comes from a
    dictionary of two generations: when the young one holds ``most`` words it becomes the old one and words that come
    again move over, so frequent words stay and memory is bounded. That changes the time only, not the ids.
    """

    def __init__(self, path: str, by_word: bool = True, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already use all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        self.by_word, self.most, self.known, self.old = by_word, most, {}, {}

    def plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        if self.wide or sys.byteorder != "little":
            return [np.array(x.ids, self.kind).tobytes() for x in found]
        return [array("H", x.ids).tobytes() for x in found]

    def apart(self, words: list[str]) -> list[bytes]:
        """Token ids of each word; words of letters are encoded many to a text, with a mark between them.

        A mark is a token of its own between letters, so the ids are cut where it stands. Should the number of cuts in a
        text not be that of its marks (a tokenizer whose words hold it), its words are encoded one by one.
        """
        lists = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
        mark = self.plain([JOINT.strip()])[0]
        if len(mark) != self.kind.itemsize:
            return self.plain(words)
        mark, size, out = np.frombuffer(mark, self.kind)[0], self.kind.itemsize, []
        for some, found in zip(lists, self.plain([JOINT.join(x) for x in lists])):
            ends = (np.flatnonzero(np.frombuffer(found, self.kind) == mark) * size).tolist()
            ids = [found[a:b] for a, b in zip([0, *(e + size for e in ends)], [*ends, len(found)])]
            out += ids if len(ids) == len(some) and all(ids) else self.plain(some)
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words that are not known; letters in lower case and marks apart."""
        known, old = self.known, self.old
        bare = [w for w in words if w.isalpha()]
        keys = [w.lower() if w.isascii() else w for w in bare]
        marked, cores, tails = [], [], []
        for word in set(words).difference(bare):
            core = word.rstrip(MARKS)
            if not core or not core[-1].isalpha() or core[-1] > "\xff":
                core = word
            key = core.lower() if core.isascii() else core
            if len(core) == len(word):
                bare.append(word)
                keys.append(key)
            else:
                marked.append(word)
                cores.append(key)
                tails.append(word[len(core):])
        new = set(keys).union(cores, tails).difference(known)
        again = new.intersection(old) if old else set()
        known.update((w, old[w]) for w in again)
        new -= again
        letters = [x for x in new if x.isalpha()]
        known.update(zip(letters, self.apart(letters)))
        others = list(new.difference(letters))
        known.update(zip(others, self.plain(others)))
        known.update(zip(bare, map(known.__getitem__, keys)))
        known.update(zip(marked, map(bytes.__add__, map(known.__getitem__, cores), map(known.__getitem__, tails))))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self.plain(texts)
        # str.split also cuts at the four separators of ASCII, which a tokenizer need not take for white space
        parts = [SPACE.findall(x) if SEPARATOR.search(x) else x.split() for x in texts]
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        missing = set().union(*parts).difference(known)
        again = missing.intersection(old) if old else set()
        known.update((w, old[w]) for w in again)
        self.learn(list(missing - again))
        return [b"".join(map(known.__getitem__, p)) for p in parts]


def encoder(path: str, by_word: bool) -> Encoder:
    """One encoder for each worker process."""
    if (path, by_word) not in _LOADED:
        _LOADED[path, by_word] = Encoder(path, by_word)
    return _LOADED[path, by_word]


class Packer:
    """Cuts a stream of documents into sequences and writes them in batches."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        item = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([
            ("ids", pa.list_(item, length)), ("mask", pa.list_(pa.bool_(), length)), ("doc_ids", pa.list_(pa.int64())),
            ("doc_starts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())),
        ], {"length": str(length), "rows_per_batch": str(rows)})
        self.kind, self.item, self.length, self.rows = kind, item, length, rows
        self.writer = pa.ipc.new_stream(sink, self.schema)
        self.held, self.docs, self.done, self.total = bytearray(), [], 0, 0

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // self.kind.itemsize
        self.docs.append((doc_id, self.total, n))
        self.held += ids
        self.total += n
        while len(self.held) >= self.length * self.rows * self.kind.itemsize:
            self.flush(self.rows)

    def flush(self, rows: int) -> None:
        size = rows * self.length
        cut = size * self.kind.itemsize
        ids = np.frombuffer(bytes(self.held[:cut]), self.kind)
        del self.held[:cut]
        real = len(ids)
        ids = np.concatenate([ids, np.zeros(size - real, self.kind)]) if real < size else ids
        ends = [self.done + self.length * (r + 1) for r in range(rows)]
        lists, at = [[], [], []], 0
        for end in ends:
            first = at
            while at < len(self.docs) and self.docs[at][1] < end:
                at += 1
            for column, values in enumerate(zip(*self.docs[first:at])) if at > first else ((c, ()) for c in range(3)):
                lists[column].append(list(values))
        del self.docs[:at]
        self.done += size
        fixed = lambda values: pa.FixedSizeListArray.from_arrays(values, self.length)
        self.writer.write_batch(pa.record_batch([
            fixed(pa.array(ids, self.item)), fixed(pa.array(np.arange(size) < real)),
            *(pa.array(x, pa.list_(pa.int64())) for x in lists)], schema=self.schema))

    def close(self) -> None:
        """Write what is left, padded to whole sequences."""
        left = len(self.held) // self.kind.itemsize
        if left or self.docs:
            self.flush(max(1, -(-left // self.length)))
        self.writer.close()


class TokenFile:
    """Random access to the sequences of one file; nothing is copied from a memory map."""

    def __init__(self, path: str):
        reader = pa.ipc.open_stream(pa.memory_map(path))
        self.batches = list(reader)
        self.length, self.rows = (int(reader.schema.metadata[k]) for k in (b"length", b"rows_per_batch"))

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def ids(self, n: int) -> np.ndarray:
        batch, row = self.batches[n // self.rows], n % self.rows
        values = batch.column(0).values
        return values.slice(row * self.length, self.length).to_numpy(zero_copy_only=True)

    def mask(self, n: int) -> np.ndarray:
        batch, row = self.batches[n // self.rows], n % self.rows
        return batch.column(1).values.slice(row * self.length, self.length).to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text",
                      end_id: int | None = END_ID, by_word: bool = True, length: int = LENGTH,
                      rows_per_batch: int = ROWS_PER_BATCH, parts: int | None = None) -> DataFrame:
    """Write the files below ``folder`` (any store that pyarrow can open); returns file, n_docs and n_tokens."""
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("d"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    dealt = rows.repartitionByRange(parts, "d").sortWithinPartitions("d", "t")

    def write(batches):
        from pyspark import TaskContext

        encode, packer = encoder(tokenizer, by_word), None
        tail = b"" if end_id is None else np.array([end_id], encode.kind).tobytes()
        context = TaskContext.get()
        store, base = pafs.FileSystem.from_uri(folder)
        name = f"{base}/part-{context.partitionId():06d}.arrow"
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                store.create_dir(base, recursive=True)
                sink = store.open_output_stream(f"{base}/_writing-{context.taskAttemptId()}")
                packer = Packer(sink, encode.kind, length, rows_per_batch)
            for d, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                packer.add(d, ids + tail)
            n += batch.num_rows
        if packer:
            packer.close()
            sink.close()
            store.move(f"{base}/_writing-{context.taskAttemptId()}", name)
            yield pa.record_batch({"file": [f"part-{context.partitionId():06d}.arrow"], "n_docs": [n], "n_tokens": [packer.total]})

    return dealt.mapInArrow(write, "file string, n_docs long, n_tokens long")


def read_token_files(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """Documents of the files: file, doc_id, place (in the file), n_tokens, ids_crc32 (of 32-bit ids).

    A task streams through the files dealt to it, one batch at a time. ``files`` are names, one for each task that
    wrote, so the list is as short as the number of partitions.
    """
    names = spark.createDataFrame([(x,) for x in files], "file string").repartition(max(1, len(files)), "file")

    def read(batches):
        for batch in batches:
            store, base = pafs.FileSystem.from_uri(folder)
            for name in batch.column(0).to_pylist():
                with store.open_input_file(f"{base}/{name}") as source:
                    for found in documents(pa.ipc.open_stream(source)):
                        rows = list(zip(*found))
                        yield pa.record_batch([
                            pa.array([name] * len(found)), pa.array(rows[0], pa.int64()),
                            *(pa.array(x, pa.int64()) for x in rows[1:])],
                            names=["file", "doc_id", "place", "n_tokens", "ids_crc32"])

    return names.mapInArrow(read, "file string, doc_id long, place long, n_tokens long, ids_crc32 long")


def documents(reader):
    """Lists of (doc_id, place, tokens, crc), a document once its last token has been read."""
    open_docs, at = [], 0
    for batch in reader:
        ids = batch.column(0).values.to_numpy()
        begun = [batch.column(c).flatten().to_pylist() for c in (2, 3, 4)]
        open_docs += [[d, s, n, 0] for d, s, n in zip(*begun)]
        done, upto = 0, at + len(ids)
        for doc in open_docs:
            first, last = max(doc[1], at), min(doc[1] + doc[2], upto)
            if first < last:
                doc[3] = zlib.crc32(ids[first - at:last - at].astype("<u4").tobytes(), doc[3])
            if doc[1] + doc[2] > upto:
                break
            done += 1
        if done:
            yield [tuple(x) for x in open_docs[:done]]
            del open_docs[:done]
        at = upto


def token_table(docs: DataFrame, folder: str, tokenizer: str, **options) -> DataFrame:
    """Write the files, read them back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, place."""
    spark = docs.sparkSession
    # one small row for each file
    files = sorted(write_token_files(docs, folder, tokenizer, **options).collect())
    starts, total = [], 0
    for f in files:
        starts.append((f.file, total))
        total += f.n_tokens
    # as short as the list of files
    offsets = spark.createDataFrame(starts, "file string, before long")
    found = read_token_files(spark, folder, [f.file for f in files])
    return found.join(F.broadcast(offsets), "file").select(
        "doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "ids_crc32", "file", "place")


@query("op2_token_files")
def op2(spark, sf_dir):
    """Token ids of all documents, written as equal-length sequences and read back from the files."""
    import public_tokenizers

    folder = scratch_path(spark, "tokens")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    return token_table(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
