"""Token-ID files with an index by document key.

``write`` encodes every text and writes the ids, in ascending order of the documents' keys,
to shards; ``read`` gives the ids of any keys in constant time each.

A shard is a raw payload of little-endian ids of ``width`` bytes (2 where the vocabulary
allows it), then ``docs + 1`` 64-bit starts (in ids), then a tail: magic, width, docs, ids. A
task streams its sorted range of documents into shards of about ``SHARD_BYTES``; names are
never used twice, and a shard counts only if the task that wrote it succeeded, so what a lost
task left behind is never read.

The index is a minimal perfect hash, built in parts of about ``PART_KEYS`` keys. A part is a
cascade of bit arrays: a key that has its bit of a level for itself is settled there, the others
go on to the next; what many levels can't settle is listed. The rank of a settled key's bit is its
slot, which holds a fingerprint, the shard and the row in it. A key that was never written is
refused by the fingerprint (but for one in 2 ** 32). A document's key is its id and, as ids can
repeat, its number among the rows of that id.

Files are written and read by the workers through pyarrow's file systems (local or mounted
folders, object stores, HDFS), below ``folder``, which all executors must reach.

Results by case
    null text: empty, so only the end id is written; empty table: no files, and no rows when read;
    null id: first, a key of its own; equal ids: in the order of their texts' hashes, each with its
    own number; repeated rows: each is written; long texts are encoded whole (a shard grows
    beyond its size rather than cut one); columns not named play no part.
"""

from __future__ import annotations

import json
import re
import struct
import sys
import unicodedata
import uuid
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from taxalake.operators.positions import numbered

from . import common

SHARD_BYTES = 1 << 25
SHARD_DOCS = 1 << 20
PART_KEYS = 1 << 10
#: Bits of a level per key that reaches it, and levels before the rest is listed.
GAMMA, LEVELS = 2.0, 24
#: Words that a worker remembers the ids of.
MEMORY = 1 << 19
#: Bytes of texts that are encoded together, and words of them whose ids are put in order together, or one longer text.
TEXT_BYTES = 1 << 23
WORDS_AT_ONCE = 1 << 16
MAGIC = b"TIDS"
TAIL = "<4sIQQ"


# ---------------------------------------------------------------- encoding

#: The pre-tokenizer (a fixed value) whose words are encoded apart from each other: white space only separates.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class _Kept:
    """Values of keys, made many at a time. Of more than ``limit`` those asked for longest ago are dropped."""

    def __init__(self, limit: int) -> None:
        self.limit, self.new, self.old = limit, {}, {}

    def all(self, keys: list[str], make, step: int = 1 << 12) -> list:
        """The values of keys that are all different; ``make`` gives those of a list."""
        if 2 * len(self.new) > self.limit:
            self.new, self.old = {}, self.new
        found = list(map(self.new.get, keys))
        if None in found:
            lost = [i for i, x in enumerate(found) if x is None]
            for i in lost:
                found[i] = self.old.get(keys[i])
            missing = [i for i in lost if found[i] is None]
            for a in range(0, len(missing), step):
                some = missing[a : a + step]
                for i, x in zip(some, make([keys[i] for i in some])):
                    found[i] = x
            self.new.update((keys[i], found[i]) for i in lost)
        return found


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for
    themselves, the others for the letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {**{b: chr(b) for b in shown}, **{b: chr(256 + i) for i, b in enumerate(hidden)}}


class Encoder:
    """Texts to bytes of ids. Where a tokenizer's words don't depend on their neighbours, a word is looked up
    once for many texts, those met before are remembered, and the plain pieces of the others go straight to
    the tokenizer's model, many at a time."""

    def __init__(self, path: str, end: int | None, memory: int = MEMORY) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(with_added_tokens=True), (end or 0) + 1)
        self.width = 2 if size <= 1 << 16 else 4
        self.type = f"<u{self.width}"
        self.end = b"" if end is None else end.to_bytes(self.width, "little")
        with open(path) as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        lower = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers") or []]
        model, letters = spec.get("model") or {}, _byte_letters()
        vocab, suffix = self.tokenizer.get_vocab(with_added_tokens=False), model.get("end_of_word_suffix") or ""
        self.apart = (
            (steps[0].get("pattern") or {}).get("Regex") == WORDS and lower == ["NFC", "Replace", "Lowercase"]
            and [x.get("type") for x in steps] == ["Split", "ByteLevel"] and not spec.get("post_processor")
            # the last id of a piece, and no other, stands for letters with the suffix
            and bool(suffix) and not model.get("ignore_merges") and all(x in vocab and x + suffix in vocab for x in letters.values())
        )
        self.last = np.zeros(size, dtype=bool)
        self.last[[i for x, i in vocab.items() if x.endswith(suffix)]] = True
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = CharDelimiterSplit(" ")
        self.letters = {**letters, 32: " "}
        self.words, self.pieces = _Kept(memory), _Kept(memory)
        # white space that the tokenizer knows and Arrow's ASCII words don't end at
        self.space = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
        # a word's pieces; words are a space apart, and a line end only separates
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\x80-\U0010ffff]+|[0-9]| |[^A-Za-z0-9\x80-\U0010ffff \n]+")

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, dtype=self.type).tobytes()

    def plain(self, text: str) -> bytes:
        return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of pieces that the pre-tokenizer leaves whole, None for those that it may not."""
        whole = [
            x.lower() if x.isascii()
            else y if x.isalpha() and "Σ" not in x and (y := unicodedata.normalize("NFC", x).lower()).isalpha()
            else None
            for x in pieces
        ]
        line = " ".join([x for x in whole if x is not None]).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=self.type)
        data, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * self.width).tolist()
        made = (data[a:b] for a, b in zip([0, *ends], ends))
        return [None if x is None else next(made) for x in whole]

    def _words(self, words: list[str]) -> list[bytes]:
        plain = [self.space.sub("\n", x) if not x.isascii() else x for x in words]
        plain = [x.lower() if x.isascii() else x for x in plain]
        # none of the others' pieces
        odd = ["<|" in x or "'" in x and not x.isascii() for x in plain]
        cut = self.cut.findall(" ".join(["" if o else x for x, o in zip(plain, odd)]))
        pieces = list({x: None for x in cut if x != " "})
        ids = dict(zip(pieces, self.pieces.all(pieces, self._pieces)))
        out, own = [], []
        for x in [*cut, " "]:
            if x != " ":
                own.append(ids[x])
                continue
            out.append(self.plain(words[len(out)]) if odd[len(out)] or None in own else b"".join(own))
            own = []
        return out

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        if not self.apart:
            texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
            return [self._bytes(x.ids) + self.end for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = pc.ascii_split_whitespace(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        words = cut.flatten().dictionary_encode()
        known = self.words.all(words.dictionary.to_numpy(zero_copy_only=False).tolist(), self._words)
        ids, code, at = np.frombuffer(b"".join(known), dtype=self.type), words.indices.to_numpy(), cut.offsets.to_numpy()
        n = np.fromiter(map(len, known), np.int64, len(known)) // self.width
        first, out = np.cumsum(n) - n, []
        for a, b in _cuts(at[1:], WORDS_AT_ONCE):
            some = code[at[a] : at[b]]
            ends = np.concatenate([[0], np.cumsum(n[some])])
            data = ids[np.repeat(first[some] - ends[:-1], n[some]) + np.arange(ends[-1])]
            ends = ends[at[a : b + 1] - at[a]].tolist()
            out.extend(data[x:y].tobytes() + self.end for x, y in zip(ends, ends[1:]))
        return out


def encoder_of(path: str, end: int | None) -> Encoder:
    """The encoder that this worker process keeps over its tasks."""
    kept = sys.modules.setdefault("_taxalake_encoders", ModuleType("_taxalake_encoders")).__dict__
    key = f"{path} {end}"
    if key not in kept:
        kept[key] = Encoder(path, end)
    return kept[key]


def _cuts(totals: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of consecutive rows of about ``size`` together, by their running totals."""
    cuts = np.flatnonzero(np.diff(totals // size, prepend=-1)).tolist()
    return zip(cuts, [*cuts[1:], len(totals)])


def _portions(texts: pa.Array) -> Iterator[pa.Array]:
    """Consecutive texts of about ``TEXT_BYTES`` together."""
    totals = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    return (texts.slice(a, b - a) for a, b in _cuts(totals, TEXT_BYTES))


# ---------------------------------------------------------------- files


def _open(folder: str):
    """The file system of a folder, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("/") else re.sub(r"^file:/*", "file:///", folder))


class Shard:
    """One shard as it is written."""

    def __init__(self, folder: str, width: int) -> None:
        files, at = _open(folder)
        self.name, self.width = f"{uuid.uuid4().hex}.ids", width
        self.out, self.starts = files.open_output_stream(f"{at}/{self.name}"), [0]

    def add(self, ids: bytes) -> None:
        self.out.write(ids)
        self.starts.append(self.starts[-1] + len(ids) // self.width)

    def full(self) -> bool:
        return self.starts[-1] * self.width >= SHARD_BYTES or len(self.starts) > SHARD_DOCS

    def close(self) -> None:
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(struct.pack(TAIL, MAGIC, self.width, len(self.starts) - 1, self.starts[-1]))
        self.out.close()


def _starts(f) -> tuple[int, np.ndarray]:
    """The width and the starts of an open shard."""
    size, tail = f.size(), struct.calcsize(TAIL)
    magic, width, docs, _ = struct.unpack(TAIL, f.read_at(tail, size - tail))
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    at = size - tail - 8 * (docs + 1)
    return width, np.frombuffer(f.read_at(8 * (docs + 1), at), dtype="<u8").astype(np.int64)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the shards. Returns id, part and seq (the order of shards), file, row, n of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys = [F.col("id").asc_nulls_first(), F.col("tie"), F.col("last")]
    # equal ids by their texts' hashes; the row's number lets copies be dealt over tasks
    rows = rows.withColumns({"tie": F.xxhash64("text"), "last": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard, seq = None, None, 0
        for batch in it:
            if not batch.num_rows:
                continue
            encoder = encoder or encoder_of(tokenizer, end)
            out: list[tuple] = []
            for some in _portions(batch.column("text")):
                for ids in encoder.encode(some):
                    if shard is None:
                        shard = Shard(folder, encoder.width)
                    out.append((seq, shard.name, len(shard.starts) - 1, len(ids) // encoder.width))
                    shard.add(ids)
                    if shard.full():
                        shard.close()
                        shard, seq = None, seq + 1
            made = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part").cast(pa.int64()), *made], names=["id", "part", "seq", "file", "row", "n"])
        if shard is not None:
            shard.close()

    return ranged.select("id", "text", "part").mapInArrow(run, f"id {id_type}, part long, seq long, file string, row long, n long")


# ---------------------------------------------------------------- minimal perfect hash


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """The bit of each key (two hashes) in a level of ``size`` bits."""
    return (mix(h[0] + np.uint64(2 * level + 1) * h[1]) % np.uint64(size)).astype(np.int64)


def build_part(h: np.ndarray, entries: np.ndarray) -> bytes:
    """The bytes of an index part: ``h`` has two 64-bit hashes a key (2, n), all pairs different;
    ``entries`` (n, 3) 32-bit fingerprint, shard and row."""
    left, order, bits = np.arange(h.shape[1]), [], []
    for level in range(LEVELS):
        if not len(left):
            break
        size = max(8, int(len(left) * GAMMA))
        at = _bit(h[:, left], level, size)
        alone = np.bincount(at, minlength=size) == 1
        settled = alone[at]
        mine = left[settled]
        order.append(mine[np.argsort(at[settled])])
        bits.append(alone)
        left = left[~settled]
    rest = left[np.lexsort((h[1, left], h[0, left]))]
    order = np.concatenate([*order, rest]) if order or len(rest) else left
    head = struct.pack("<III", h.shape[1], len(bits), len(rest)) + b"".join(struct.pack("<I", len(b)) for b in bits)
    body = b"".join(np.packbits(b, bitorder="little").tobytes() for b in bits)
    listed = np.ascontiguousarray(h[:, rest].T).astype("<u8").tobytes()
    return head + body + listed + np.ascontiguousarray(entries[order]).astype("<u4").tobytes()


def find_in_part(part: bytes, h: np.ndarray) -> np.ndarray:
    """The entries (n, 3) of keys; a key that isn't there gets any entry, or -1 where there is none."""
    n, levels, rest = struct.unpack_from("<III", part)
    sizes = struct.unpack_from(f"<{levels}I", part, 12)
    at, before = 12 + 4 * levels, 0
    slot = np.full(h.shape[1], -1, dtype=np.int64)
    for level, size in enumerate(sizes):
        held = np.unpackbits(np.frombuffer(part, np.uint8, -(-size // 8), at), bitorder="little")[:size].astype(np.int64)
        rank = np.cumsum(held) - held + before
        b = _bit(h, level, size)
        hit = (slot < 0) & (held[b] == 1)
        slot[hit] = rank[b[hit]]
        at, before = at + -(-size // 8), before + int(held.sum())
    if rest:
        listed = np.frombuffer(part, "<u8", 2 * rest, at).reshape(rest, 2)
        place = {tuple(x): i for i, x in enumerate(listed.tolist())}
        for i in np.flatnonzero(slot < 0):
            slot[i] = place.get((int(h[0, i]), int(h[1, i])), -1 - before) + before
    entries = np.frombuffer(part, "<u4", 3 * n, at + 16 * rest).reshape(n, 3).astype(np.int64)
    return np.where((slot >= 0)[:, None], entries[np.maximum(slot, 0)], -1) if n else np.full((h.shape[1], 3), -1)


def _key(id_col: Column, copy: Column) -> tuple[Column, ...]:
    """Two hashes and the fingerprint of a document's key."""
    text = F.concat_ws("#", F.coalesce(F.concat(F.lit("="), id_col.cast("string")), F.lit("-")), copy.cast("string"))
    return F.xxhash64(F.lit(1), text), F.xxhash64(F.lit(2), text), F.xxhash64(F.lit(3), text).bitwiseAND(F.lit(0xFFFFFFFF))


def _part_of(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def _runs(it: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[int, pa.Table]]:
    """Consecutive rows that are equal in ``column``, gathered over batches."""
    now, held = None, []
    for batch in it:
        values = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            if held and values[a] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = values[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield now, pa.Table.from_batches(held)


def _pair(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("h1", "h2")])


def write_index(entries: DataFrame, folder: str, bits: int) -> DataFrame:
    """Writes the index of h1, h2, mark (fingerprint), shard and row, 2 ** (bits // 2) parts a file.
    Returns file_no and file."""
    def parts(it):
        for part, t in _runs(it, "part"):
            data = np.stack([t.column(c).to_numpy() for c in ("mark", "shard", "row")], axis=1)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "blob": pa.array([build_part(_pair(t), data)], pa.binary())})

    def file(it):
        for no, t in _runs(it, "file_no"):
            blobs = dict(zip(t.column("part").to_pylist(), t.column("blob").to_pylist()))
            first, count = int(no) << (bits // 2), 1 << (bits // 2)
            empty = build_part(np.zeros((2, 0), np.uint64), np.zeros((0, 3), np.int64))
            own = [blobs.get(first + i, empty) for i in range(count)]
            name = f"{uuid.uuid4().hex}.mph"
            files, at = _open(folder)
            with files.open_output_stream(f"{at}/{name}") as out:
                out.write(np.cumsum([8 * (count + 1), *map(len, own)]).astype("<u8").tobytes())
                for blob in own:
                    out.write(blob)
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int64()), "file": [name]})

    dealt = entries.withColumn("part", _part_of(F.col("h1"), bits)).repartition("part").sortWithinPartitions("part")
    made = dealt.select("part", "h1", "h2", "mark", "shard", "row").mapInArrow(parts, "part long, blob binary")
    made = made.withColumn("file_no", F.shiftright("part", bits // 2)).repartition("file_no").sortWithinPartitions("file_no", "part")
    return made.mapInArrow(file, "file_no long, file string")


# ---------------------------------------------------------------- the operator


class TokenFiles:
    """What ``write`` has written: ``shards`` (shard, file, docs, ids, first) and ``index`` (file_no, file)."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.shards, self.index = (spark.read.parquet(f"{folder}/{x}.parquet") for x in ("shards", "index"))
        meta = spark.read.parquet(f"{folder}/meta.parquet").first()
        self.bits, self.documents = meta["bits"], meta["documents"]

    def lookup(self, keys: DataFrame, id_col: str = "doc_id", copy: str = "copy") -> DataFrame:
        """``keys`` with shard and row, where the index has them."""
        h1, h2, mark = _key(F.col(id_col), F.col(copy))
        asked = keys.select(F.col(id_col).alias("id"), F.col(copy).cast("long").alias("copy"), h1.alias("h1"), h2.alias("h2"), mark.alias("mark"))
        asked = asked.withColumn("part", _part_of(F.col("h1"), self.bits)).withColumn("file_no", F.shiftright("part", self.bits // 2))
        # the names of the index's files: one row a file
        asked = asked.join(self.index.hint("merge"), "file_no").repartition("part").sortWithinPartitions("part")
        folder, low = self.folder, (1 << (self.bits // 2)) - 1

        def run(it):
            name, f = None, None
            for part, t in _runs(it, "part"):
                files, at = _open(folder)
                if (own := t.column("file")[0].as_py()) != name:
                    name, f = own, files.open_input_file(f"{at}/{own}")
                a, b = np.frombuffer(f.read_at(16, 8 * (int(part) & low)), "<u8").tolist()
                found = find_in_part(f.read_at(b - a, a), _pair(t))
                t = t.append_column("shard", pa.array(found[:, 1])).append_column("row", pa.array(found[:, 2]))
                known = found[:, 0] == t.column("mark").to_numpy()
                yield from t.select(["id", "copy", "shard", "row"]).filter(pa.array(known)).to_batches()

        id_type = asked.schema["id"].dataType.simpleString()
        return asked.mapInArrow(run, f"id {id_type}, copy long, shard long, row long")

    def read(self, keys: DataFrame, id_col: str = "doc_id", copy: str = "copy") -> DataFrame:
        """id, copy, start (ids of all documents before), n and ids (little-endian, 32 bits each) of the
        documents with these keys; no row for a key that was never written."""
        found = self.lookup(keys, id_col, copy)
        id_type = found.schema["id"].dataType.simpleString()
        found = found.join(self.shards.select("shard", "file", "first").hint("merge"), "shard")
        found = found.repartition("file").sortWithinPartitions("file", "row")
        folder = self.folder

        def run(it):
            name, f, width, starts = None, None, 0, None
            for batch in it:
                ids, copies, first = (batch.column(c) for c in ("id", "copy", "first"))
                out, size, a = [], 0, 0
                for i, (own, row) in enumerate(zip(batch.column("file").to_pylist(), batch.column("row").to_pylist())):
                    if own != name:
                        files, at = _open(folder)
                        name, f = own, files.open_input_file(f"{at}/{own}")
                        width, starts = _starts(f)
                    b, e = int(starts[row]), int(starts[row + 1])
                    raw = np.frombuffer(f.read_at((e - b) * width, b * width), f"<u{width}").astype("<u4").tobytes()
                    out.append((first[i].as_py() + b, e - b, raw))
                    size += len(raw)
                    if size >= 1 << 23 or i == batch.num_rows - 1:
                        made = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))]
                        yield pa.RecordBatch.from_arrays([ids.slice(a, len(out)), copies.slice(a, len(out)), *made], names=["id", "copy", "start", "n", "ids"])
                        out, size, a = [], 0, i + 1

        return found.select("id", "copy", "file", "row", "first").mapInArrow(run, f"id {id_type}, copy long, start long, n long, ids binary")


def write(docs: DataFrame, folder: str, tokenizer: str, end: int | None = 1, id_col: str = "doc_id", text: str = "text") -> TokenFiles:
    """Encodes ``docs`` into files below ``folder`` (which the workers and Spark both reach)."""
    spark = docs.sparkSession
    files, at = _open(folder)
    files.create_dir(at)
    listed = common.durable(write_shards(docs, folder, tokenizer, end, id_col, text))
    shards = listed.groupBy("part", "seq", "file").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"))
    # one row a shard
    order = Window.orderBy("part", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(
        (F.row_number().over(order) - 1).cast("long").alias("shard"), "file", "docs", "ids",
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"),
    )
    shards.write.parquet(f"{folder}/shards.parquet")
    shards = spark.read.parquet(f"{folder}/shards.parquet")
    placed = listed.join(shards.select("file", "shard").hint("merge"), "file").select("id", "shard", "row")
    keyed = numbered(placed, ["shard", "row"], by=["id"], name="copy", first=0)
    h1, h2, mark = _key(F.col("id"), F.col("copy"))
    entries = common.durable(keyed.select(h1.alias("h1"), h2.alias("h2"), mark.alias("mark"), "shard", "row"))
    n = entries.count()
    bits = max(0, (max(n, 1) - 1) // PART_KEYS).bit_length()
    write_index(entries, folder, bits).write.parquet(f"{folder}/index.parquet")
    spark.createDataFrame([(bits, n)], "bits int, documents long").write.parquet(f"{folder}/meta.parquet")
    return TokenFiles(spark, folder)


def keys_of(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The keys of all documents: id and copy (its number among the rows of that id)."""
    return numbered(docs.select(F.col(id_col).alias("doc_id")), [], by=["doc_id"], name="copy", first=0)
