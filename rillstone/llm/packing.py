"""Packing documents into sequences of bounded length by linear grouping and best fit.

Pieces of equal length are interchangeable, so the plan is made from the histogram of lengths
alone, which has at most as many rows as a sequence has tokens. Documents meet the plan through
their ordinal within their length, counted over salted groups: nothing whole passes the driver.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import per_batch, sized, slices, stage

CAPACITY = 2048
#: Equal-cardinality groups of large lengths; lengths up to SMALL are placed by best fit.
GROUPS, SMALL = 512, 128
#: Rows of a length that are numbered in one task, about.
PER_SALT = 2000
#: Bytes of pre-tokens and ids of a generation that a Python worker remembers, of other words, and what an entry costs besides.
CORES, CACHED, ENTRY = 80 << 20, 20 << 20, 160
_tokenizers: dict = {}


class _Memory(dict):
    """Ids by word; unknown words are made. When it is full, ``turn`` begins another one, and what is not used again goes."""

    def __init__(self, most: int, make: Callable[[bytes], bytes], old: dict | None = None):
        super().__init__()
        self.most, self.make, self.size, self.old = most, make, 0, old or {}

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.make(word)
        self[word] = ids
        self.size += len(word) + len(ids) + ENTRY
        return ids

    def turn(self) -> _Memory:
        if self.size <= self.most:
            return self
        self.old = {}
        return _Memory(self.most, self.make, self)


#: Per tokenizer file what a worker remembers: ids of pre-tokens, ids of words of other texts.
_cores: dict[str, _Memory] = {}
_words: dict[str, _Memory] = {}

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def tokenizer(path: str):
    """The tokenizer of a file, loaded once per Python worker."""
    if path not in _tokenizers:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


def forget(path: str) -> None:
    """Free the tokenizer where only its tables are needed from now on."""
    _tokenizers.pop(path, None)


def encode_words(words: list[str], path: str) -> list[list[int]]:
    """Ids of each word, encoded by itself."""
    out, t = [], tokenizer(path)
    for i in range(0, len(words), 4096):
        out += [e.ids for e in t.encode_batch_fast(words[i : i + 4096], add_special_tokens=False)]
    return out


_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: How the byte-level vocabulary writes bytes: printable ones as themselves, the others from U+0100 on.
BYTE_LETTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_LETTERS, _NUMBERS = "a-zª\u00b5ºß-öø-ÿ", "0-9²³¹¼-¾"
#: The tokenizer's pre-tokens of lower-case text of the first 256 characters, which needs no composition.
_PRETOKENS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
#: The characters that this holds for, as Latin-1: no controls, no space that bytes do not know as one. Lower case of each, and its kind.
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(161, 256)])
_LOWER = bytes(ord(chr(b).lower()) for b in range(256))
_SPACE, _LETTER, _NUMBER, _SIGN, _QUOTE = range(5)
_KINDS = np.array([_SPACE if chr(b).isspace() or not b else _QUOTE if chr(b) == "'" else _LETTER if chr(b).isalpha() else _NUMBER if chr(b).isnumeric() else _SIGN for b in range(256)], np.uint8)
#: Whether a pre-token ends between two kinds, whatever stands around them; at a quote that depends.
_ENDS = np.array([[x != y if _QUOTE not in (x, y) and _SPACE not in (x, y) else False for y in range(5)] for x in range(5)])
_ENDS[_NUMBER, _NUMBER] = True
_ENDS = _ENDS.ravel()


def _memories(path: str) -> tuple[_Memory, _Memory]:
    """Empty memories of pre-tokens (with quotes, several of them), which go to the model as they are, and of words, which take the whole tokenizer."""
    whole, tokenize, pack = tokenizer(path), tokenizer(path).model.tokenize, struct.pack
    tokenizer(path).model._resize_cache(0)  # remembered here

    def core_ids(core: bytes) -> bytes:
        text = core.decode("latin-1")
        ids = [t.id for part in ((text,) if text.isalpha() else _PRETOKENS.findall(text)) for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS))]
        return pack(f"<{len(ids)}I", *ids)

    def word_ids(word: bytes) -> bytes:
        return array("I", whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    return _Memory(CORES, core_ids), _Memory(CACHED, word_ids)


def _plain(text: str) -> bytes | None:
    """The text in Latin-1, or None if it has other characters, or marks as special tokens have them."""
    try:
        own = text.encode("latin-1")
    except UnicodeEncodeError:
        return None
    return None if own.translate(None, _PLAIN) or b"<|" in own else own


def pretokens(texts: list[bytes]) -> list[bytes]:
    """Texts as ``_plain`` gives them in lower case, with a space wherever a pre-token ends."""
    if not texts:
        return []
    low = np.frombuffer(b"\0".join(texts).translate(_LOWER), np.uint8)
    kinds = _KINDS[low]
    ends = np.flatnonzero(_ENDS[kinds[:-1] * np.uint8(5) + kinds[1:]]) + 1
    return np.insert(low, ends, 32).tobytes().split(b"\0")


def document_ids(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian uint32. Pre-tokens are encoded by themselves, and the tokenizer drops white space and
    never joins over it, so a text's ids are those of its pre-tokens, or of its words where it has other characters."""
    if path not in _cores:
        _cores[path], _words[path] = _memories(path)
    plain = [_plain(text) for text in texts]
    parted = iter(pretokens([own for own in plain if own is not None]))
    for text, own in zip(texts, plain, strict=True):
        if own is None:
            yield b"".join(map(_words[path].__getitem__, text.encode("utf-8", "replace").split()))
        else:
            yield b"".join(map(_cores[path].__getitem__, next(parted).split()))
        _cores[path], _words[path] = _cores[path].turn(), _words[path].turn()


def _pieces(path: str, capacity: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in slices(batch, 1, 2 << 20):
            doc, piece, start, length, crc = [], [], [], [], []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for doc_id, ids in zip(part.column(0).to_pylist(), document_ids(texts, path), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    doc.append(doc_id)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(own) // 4)
                    crc.append(zlib.crc32(own))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((doc, piece, start, length, crc), kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return per_batch(run)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """A row per piece: each document's ids and the end id, cut at ``capacity`` tokens."""
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or default_tokenizer(), capacity, end_id), PIECES)


class _Bins:
    """Runs of sequences with equal free space: (first sequence, how many), by free space."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.mask, self.made = capacity, [[] for _ in range(capacity + 1)], 0, 0

    def put(self, free: int, first: int, n: int) -> None:
        if free:
            self.runs[free].append((first, n))
            self.mask |= 1 << free

    def tightest(self, size: int) -> int:
        """The smallest free space of at least ``size``; 0 if there is none."""
        high = self.mask >> size
        return size + (high & -high).bit_length() - 1 if high else 0

    def take(self, free: int) -> tuple[int, int]:
        run = self.runs[free].pop()
        if not self.runs[free]:
            self.mask ^= 1 << free
        return run


def _configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size (descending) to put into a sequence: the largest that is left, then the
    fullest sum that bounded counts allow, with few and large ones."""
    first = next(i for i, n in enumerate(left) if n)
    room, use = capacity - sizes[first], [0] * len(sizes)
    use[first] = 1
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for i in range(first, len(sizes)):
        s = sizes[i]
        for _ in range(min(left[i] - (i == first), room // s)):
            wider = (reach | reach << s) & full
            if wider == reach:
                break
            steps.append((i, reach))
            reach = wider
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> total & 1:
            use[i] += 1
            total -= sizes[i]
    return use


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> tuple[np.ndarray, int]:
    """Where pieces go, from ``counts`` of each length.

    Returns rows (length, first ordinal, first sequence, offset) and the number of sequences:
    piece number i of that length, from the row's first ordinal on to the next row's, goes to
    sequence first + (i - first ordinal) at the offset.
    """
    rows: list[tuple[int, int, int, int]] = []
    bins = _Bins(capacity)
    if counts.get(capacity):
        rows.append((capacity, 0, 0, 0))
        bins.made = counts[capacity]

    # Large lengths, descending, dealt into groups of equal cardinality; a group counts as its longest.
    large = [(n, counts[n]) for n in sorted(counts, reverse=True) if small < n < capacity and counts[n]]
    each = max(1, -(-sum(c for _, c in large) // groups))
    sizes: list[int] = []
    left: list[int] = []
    members: list[list[list[int]]] = []  # by size: [length, first ordinal, how many], longest first
    room = 0
    for n, c in large:
        at = 0
        while at < c:
            if not room:
                room = each
                if not sizes or sizes[-1] != n:
                    sizes.append(n)
                    left.append(0)
                    members.append([])
            k = min(room, c - at)
            members[-1].append([n, at, k])
            left[-1] += k
            room -= k
            at += k

    # Configurations of the few sizes, each used as often as its sizes last; then the documents' own
    # lengths take the places of the rounded ones.
    while any(left):
        use = _configuration(sizes, left, capacity)
        times = min(left[i] // u for i, u in enumerate(use) if u)
        slots: list[list[list[int]]] = []
        for i, u in enumerate(use):
            left[i] -= u * times
            for _ in range(u):
                need, runs = times, []
                while need:
                    run = members[i][0]
                    k = min(need, run[2])
                    runs.append([run[0], run[1], k])
                    run[1] += k
                    run[2] -= k
                    need -= k
                    if not run[2]:
                        members[i].pop(0)
                slots.append(runs)
        done = 0
        while done < times:
            k = min(s[0][2] for s in slots)
            offset = 0
            for s in slots:
                n, at, _ = s[0]
                rows.append((n, at, bins.made, offset))
                offset += n
                s[0][1] += k
                s[0][2] -= k
                if not s[0][2]:
                    s.pop(0)
            bins.put(capacity - offset, bins.made, k)
            bins.made += k
            done += k

    # Small lengths by best fit, the longest first.
    for n in sorted((n for n in counts if n <= min(small, capacity - 1)), reverse=True):
        at, count = 0, counts[n]
        while at < count:
            free = bins.tightest(n)
            if not free:
                more = -(-(count - at) // (capacity // n))
                bins.put(capacity, bins.made, more)
                bins.made += more
                continue
            first, k = bins.take(free)
            if k > count - at:
                bins.put(free, first + count - at, k - count + at)
                k = count - at
            rows.append((n, at, first, capacity - free))
            bins.put(free - n, first, k)
            at += k
    return np.array(sorted(rows), np.int64).reshape(-1, 4), bins.made


def _placed(table: np.ndarray):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        length, ordinal = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "ordinal"))
        row = table[np.searchsorted(key, length << 44 | ordinal, side="right") - 1]
        own = batch.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        yield pa.RecordBatch.from_arrays([*own.columns, pa.array(row[:, 2] + ordinal - row[:, 1]), pa.array(row[:, 3])], [*own.schema.names, "sequence_id", "offset"])

    return per_batch(run)


def histogram(made: DataFrame) -> dict[int, int]:
    """How many rows have each ``length``; lengths are at most a sequence's, so it has few entries."""
    return {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}


def with_ordinal(made: DataFrame, counts: dict[int, int], order: list[str]) -> DataFrame:
    """Rows with their ``ordinal`` (from 0) among those of their ``length``, in no order that means anything.

    Rows of a length are dealt into salts by their number, so that a length that many rows have is no
    hot key; ``order`` must tell rows apart that are not interchangeable, so that a task that runs again
    numbers them alike.
    """
    many = [(n, c // PER_SALT + 1) for n, c in counts.items() if c > PER_SALT]
    salts = F.lit(1) if not many else F.coalesce(F.create_map(*[F.lit(x) for row in many for x in row])[F.col("length").cast("int")], F.lit(1))
    rows = made.withColumn("salt", F.pmod(F.xxhash64(*order), salts))
    per_salt = rows.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_salt = sized(stage(per_salt.select("length", "salt", before.alias("before")), "salts"))
    number = F.row_number().over(Window.partitionBy("length", "salt").orderBy(*order))
    return rows.withColumn("number", number).join(per_salt, ["length", "salt"]).withColumn("ordinal", F.col("before") + F.col("number") - 1).drop("salt", "before", "number")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece of each document.

    Null texts count as empty: they hold the end id alone. Rows that repeat or have no doc_id are
    packed like any other. An empty table gives no rows.
    """
    made = stage(pieces(docs, path, capacity, end_id), "pieces")
    counts = histogram(made)
    table, _ = plan(counts, capacity)
    numbered = with_ordinal(made, counts, ["doc_id", "piece", "ids_crc32"])
    return numbered.mapInArrow(_placed(table), PIECES + ", sequence_id long, offset long")
