"""Token ids in flat binary files.

A data set is a folder with, for each partition, ``<name>.bin`` (token ids, unsigned integers of 2 or
4 bytes, little-endian, whichever the vocabulary needs) and ``<name>.idx`` (64-bit unsigned offsets in
tokens from the partition's begin, one more than documents; the 64-bit document ids; a bit for each id that is null,
padded to 64 bits), and
``manifest.json``, which lists the partitions in order with their documents and tokens. A partition's
*base*, the tokens before it, is the prefix sum of the manifest's counts, so that global token
positions need no pass over the data. Readers map the files into memory.

Writing: documents are range-partitioned by id and sorted; each task writes files under a name of its
own and returns it. Only returned names enter the manifest, so lost or repeated tasks leave nothing
that counts. What reaches the driver is one row a partition.

Encoding: a single space between two other characters always begins a pre-token of byte-level BPE, and
a single line feed there is one, so texts are cut at them. Words are found with numpy; each different one is encoded once
by the library, many at a time in one string, and ids are put together by position. Words that agree in
their hash are compared by bytes. Texts with any other white space, or with a special token's string, are encoded
whole. The ids are those of the whole text either way.

Defined results: a null or empty text holds only the end id; rows with equal ids follow each other in
order of text, a null id comes last; an empty table gives a manifest without partitions; only the id
and text columns are read.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, partitions, small_batches, table

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Words that a worker remembers between batches.
REMEMBER = 1_000_000
#: Words encoded in one string.
TOGETHER = 2048
_WORD = ~K.byte_class(b" \n")
_SPACED = np.uint64(0x9E3779B97F4A7C15)

_encoders: dict = {}


class Ragged:
    """Rows of different lengths, to which more are added."""

    def __init__(self, kind):
        self.values, self.bounds, self.rows = np.zeros(1 << 16, kind), np.zeros(1 << 12, np.int64), 0

    def add(self, values: np.ndarray, lengths: np.ndarray) -> None:
        at, end = self.bounds[self.rows], self.rows + len(lengths)
        if end >= len(self.bounds):
            self.bounds = np.resize(self.bounds, 2 * end)
        if at + len(values) > len(self.values):
            self.values = np.resize(self.values, 2 * (at + len(values)))
        self.bounds[self.rows + 1 : end + 1] = at + np.cumsum(lengths)
        self.values[at : at + len(values)] = values
        self.rows = end

    def stretch(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.bounds[rows], self.bounds[rows + 1] - self.bounds[rows]


def odd_texts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether a text has white space other than a single space or line feed between two other characters."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(n, bool)
    padded = np.concatenate([data, np.zeros(2, np.uint8)])
    gap = ~_WORD[data]
    bad = (data >= 9) & (data <= 13) & (data != 10) | (data >= 28) & (data <= 31)
    bad[1:] |= gap[1:] & gap[:-1]
    full = np.flatnonzero(np.diff(offsets))
    bad[offsets[full]] |= gap[offsets[full]]
    bad[offsets[full + 1] - 1] |= gap[offsets[full + 1] - 1]
    lead = np.flatnonzero((data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    one, two, three = data[lead].astype(np.int64), padded[lead + 1].astype(np.int64), padded[lead + 2].astype(np.int64)
    point = np.where(one == 0xC2, two, (one & 15) << 12 | (two & 63) << 6 | three & 63)
    bad[lead[np.isin(point, _WIDE_SPACE)]] = True
    return np.isin(np.arange(n), np.searchsorted(offsets, np.flatnonzero(bad), "right") - 1)


#: White space beyond ASCII.
_WIDE_SPACE = np.array([0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


class Encoder:
    """Whole-text ids, put together from the ids of each different word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: Special strings would be found across a cut; texts that hold one are encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.after_space = np.zeros(self.size, bool)
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.after_space[i] = piece.startswith("\u0120")  # how byte-level BPE writes a space
        (self.feed,) = self.tokenizer.encode("\n", add_special_tokens=False).ids or [0]
        self.forget()

    def forget(self) -> None:
        self.ids, self.text = Ragged(np.uint32), Ragged(np.uint8)
        self.used = np.zeros(1 << 12, bool)
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str], spaced: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has. In one string a word begins with the piece that holds its space, or ends at a line feed."""
        groups = [words[i : i + TOGETHER] for i in range(0, len(words), TOGETHER)]
        flat, lengths = [], []
        for group, ids in zip(groups, self._encode([" " + " ".join(g) if spaced else "\n".join(g) for g in groups]), strict=True):
            begin = np.flatnonzero(self.after_space[ids]) if spaced else np.append(0, np.flatnonzero(ids == self.feed) + 1)
            if len(begin) != len(group) or begin[0]:
                each = self._encode([" " + x if spaced else x for x in group])
                flat += each
                lengths.append(np.array([len(x) for x in each], np.int64))
                continue
            width = np.diff(np.append(begin, len(ids) + (not spaced))) - (not spaced)
            flat.append(ids if spaced else ids[ids != self.feed])
            lengths.append(width)
        return np.concatenate(flat), np.concatenate(lengths)

    def _rows_of(self, w: K.Words, key: np.ndarray, first: np.ndarray, spaced: np.ndarray) -> np.ndarray:
        """Row of each different word; what is not known yet is learned."""
        start, width = w.start[first], w.end[first] - w.start[first]
        if self.ids.rows + len(key) > REMEMBER:  # keep what was met again
            keep = np.flatnonzero(self.used[self.rows])
            keys, rows, ids, text = self.keys[keep], self.rows[keep], self.ids, self.text
            self.forget()
            if 2 * len(keep) < REMEMBER:
                self._store(keys, *(x for r in (ids, text) for x in (r.values[K.spread(*r.stretch(rows))], r.stretch(rows)[1])))
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        row = self.rows[at] if len(self.keys) else np.zeros(len(key), np.int64)
        known = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        begin, length = self.text.stretch(row)
        known &= length == width
        old = np.flatnonzero(known)
        differ = self.text.values[K.spread(begin[old], width[old])] != w.data[K.spread(start[old], width[old])]
        if differ.any():  # another word of the same hash
            known[np.repeat(old, width[old])[differ]] = False
        self.used[row[known]] = True
        for kind in (True, False):
            new = np.flatnonzero(~known & (spaced[first] == kind))
            if len(new):
                raw = w.data.tobytes()
                ids, n = self._learn([raw[a : a + k].decode() for a, k in zip(start[new].tolist(), width[new].tolist(), strict=True)], kind)
                row[new] = self.ids.rows + np.arange(len(new))
                self._store(key[new], ids, n, w.data[K.spread(start[new], width[new])], width[new])
        return row

    def _store(self, keys: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, text: np.ndarray, n_bytes: np.ndarray) -> None:
        rows = self.ids.rows + np.arange(len(keys))
        self.ids.add(ids, n_ids)
        self.text.add(text, n_bytes)
        if self.ids.rows > len(self.used):
            self.used = np.append(self.used, np.zeros(self.ids.rows, bool))
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.rows = np.insert(self.keys, at, keys[order]), np.insert(self.rows, at, rows[order])

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, each followed by ``end`` if given, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = odd_texts(*K.text_buffer(texts))
        for s in self.special:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        w = K.words(texts.filter(pa.array(~odd)), _WORD)
        begins = np.isin(np.arange(len(w.doc)), w.bounds[:-1])
        spaced = ~begins & (w.data[w.start - 1] == 32)
        feed = ~begins & ~spaced
        key, first, inverse = np.unique(np.where(spaced, w.hash ^ _SPACED, w.hash), return_index=True, return_inverse=True)
        like, width = first[inverse], w.end - w.start
        if ((w.end - w.start)[like] != width).any() or (w.data[K.spread(w.start[like], width)] != w.data[K.spread(w.start, width)]).any() or (spaced[like] != spaced).any():
            odd[:] = True  # two words of one hash
            w, begins, feed, inverse = K.words(texts.slice(0, 0), _WORD), *(np.zeros(0, x) for x in (bool, bool, np.int64))
            row = np.zeros(0, np.int64)
        else:
            row = self._rows_of(w, key, first, spaced)
        begin, n = (x[inverse] for x in self.ids.stretch(row))
        total = np.concatenate([[0], np.cumsum(n + feed)])
        plain, whole = np.flatnonzero(~odd), np.flatnonzero(odd)
        lengths = np.zeros(len(texts), np.int64)
        lengths[plain] = np.diff(total[w.bounds]) if len(plain) else 0
        found = self._encode([texts[i].as_py() for i in whole.tolist()])
        lengths[whole] = [len(x) for x in found]
        lengths += end is not None
        base = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        if end is not None:
            out[base + lengths - 1] = end
        for i, x in zip(whole.tolist(), found, strict=True):
            out[base[i] : base[i] + len(x)] = x
        if len(w.doc):
            to = total[:-1] + (base[plain] - total[w.bounds[:-1]])[w.doc]
            out[to[feed]] = self.feed
            out[K.spread(to + feed, n)] = self.ids.values[K.spread(begin, n)]
        return out, lengths


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else fs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def _writer(tokenizer: str, out: str, end_id: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, name = encoder(tokenizer), f"part-{uuid.uuid4().hex}"
        store, root = _open(out)
        ids_of, null, counts, sink = [], [], [], None
        for whole in batches:
            for batch in K.slices(whole, "text"):
                if sink is None:
                    sink = store.open_output_stream(f"{root}/{name}.bin")
                ids, lengths = enc.encode(batch.column("text"), end_id)
                sink.write(ids.astype("<u4" if width == 4 else "<u2").tobytes())
                counts.append(lengths)
                ids_of.append(batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                null.append(batch.column("id").is_null().to_numpy(zero_copy_only=False))
        if sink is None:
            return
        sink.close()
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype("<u8")
        with store.open_output_stream(f"{root}/{name}.idx") as f:
            bits = np.packbits(np.concatenate(null)).tobytes()
            f.write(offsets.tobytes() + np.concatenate(ids_of).tobytes() + bits + bytes(-len(bits) % 8))
        total = int(offsets[-1])
        yield pa.RecordBatch.from_pydict({"name": [name], "docs": [len(offsets) - 1], "tokens": [total]}, schema=pa.schema([("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, files: int | None = None) -> dict:
    """Encode all texts and write the data set to ``out``, a folder that all executors reach; returns the manifest."""
    spark = docs.sparkSession
    small_batches(spark)
    width = 2 if encoder(tokenizer).size <= 1 << 16 and end_id < 1 << 16 else 4
    store, root = _open(out)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text"), F.col("text")]
    ranged = rows.repartitionByRange(files or partitions(spark), *order[:2]).sortWithinPartitions(*order)
    numbered = ranged.mapInArrow(_writer(tokenizer, out, end_id, width), "name string, docs long, tokens long").withColumn("part", F.spark_partition_id())
    done = sorted(numbered.collect(), key=lambda r: r.part)
    base, parts = 0, []
    for r in done:
        parts.append({"name": r.name, "docs": r.docs, "tokens": r.tokens, "base": base})
        base += r.tokens
    manifest = {"width": width, "end_id": end_id, "tokens": base, "parts": parts}
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def open_part(out: str, manifest: dict, part: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token ids, offsets, document ids, which of them are null) of one partition; mapped where the store is a local or mounted one."""
    store, root = _open(out)

    def load(suffix: str, kind: str) -> np.ndarray:
        path = f"{root}/{part['name']}.{suffix}"
        if isinstance(store, fs.LocalFileSystem):
            return np.memmap(path, dtype=kind, mode="r")
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype=kind)

    index = load("idx", "<u8")
    n = part["docs"]
    null = np.unpackbits(np.asarray(index[2 * n + 1 :]).view(np.uint8), count=n).astype(bool)
    return load("bin", f"<u{manifest['width']}"), index[: n + 1], index[n + 1 : 2 * n + 1].view("<i8"), null


def read_manifest(out: str) -> dict:
    store, root = _open(out)
    with store.open_input_file(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def _reader(out: str, manifest: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, docs, base in zip(*(batch.column(c).to_pylist() for c in ("name", "docs", "base")), strict=True):
                tokens, offsets, ids, null = open_part(out, manifest, {"name": name, "docs": docs})
                for a in range(0, docs, 4096):
                    cut = offsets[a : a + 4097].astype(np.int64)
                    crc = [zlib.crc32(tokens[x:y].astype("<u4").tobytes()) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                    key = pa.array(np.asarray(ids[a : a + 4096]), mask=null[a : a + 4096])
                    yield pa.RecordBatch.from_pydict({"doc_id": key, "start": pa.array(cut[:-1] + base), "n_tokens": pa.array(np.diff(cut)), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def read_documents(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    manifest = read_manifest(out)
    rows = [(p["name"], p["docs"], p["base"]) for p in manifest["parts"]]
    parts = spark.createDataFrame(rows, "name string, docs long, base long").repartition(max(1, len(rows)), "name")
    return parts.mapInArrow(_reader(out, manifest), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    import public_tokenizers

    spark = docs.sparkSession
    out = Scratch(spark, "tokens").path  # goes when the session ends
    write_tokens(docs, out, tokenizer or public_tokenizers.path(TOKENIZER))
    return read_documents(spark, out)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
