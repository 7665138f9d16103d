"""Byte-level BPE by a distinct-word table: split, encode each distinct word once, join ids back by position.

Words are cut before single spaces, where no token of the byte-level pattern can reach over: a word
stands for itself with the space before it. Texts with runs of white space, where that does not
hold, are cut by the pattern itself into exact pieces. Both kinds go to the same table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import hashing
from .common import per_batch
from .exchange import dictionary_parts, pack_arrays, through_dictionary, unpack_arrays
from .packing import BYTE_LETTERS, encode_words, forget, tokenizer

# The public pre-tokenisation pattern of byte-level BPE, and Unicode white space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = r"\t\n\v\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Texts that are cut by the pattern: a space before white space or at the end, or a zero byte.
_BY_PATTERN = f" [{WHITE}]| $|\\x00"
#: Ids that are decoded at once.
RUN = 200_000
#: Marks a word that is exact, without a space before it.
_EXACT = "\x00"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pattern_words(text: str, specials: list[str]) -> list[str]:
    import regex

    pieces = re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]
    out = []
    for p in pieces:
        out += [p] if p in specials else regex.findall(PATTERN, p)
    return [_EXACT + w for w in out]


def _words(texts: pa.Array, specials: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of a block, dictionary-encoded; word counts and row numbers of its texts (in another order)."""
    texts = texts.cast(pa.large_string()).fill_null("")
    by_pattern = pc.match_substring_regex(texts, _BY_PATTERN).to_numpy(zero_copy_only=False)
    plain, rest = np.flatnonzero(~by_pattern), np.flatnonzero(by_pattern)
    nonempty = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    plain, empty = plain[nonempty[plain]], plain[~nonempty[plain]]
    lists = pc.split_pattern(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts.take(pa.array(plain)), pa.scalar(_EXACT, pa.large_string())), " ")
    words, counts = [lists.flatten()], [pc.list_value_length(lists).to_numpy(zero_copy_only=False)]
    for t in texts.take(pa.array(rest)).to_pylist():
        own = _pattern_words(t, specials)
        words.append(pa.array(own, pa.large_string()))
        counts.append(np.array([len(own)]))
    counts.append(np.zeros(len(empty), np.int64))
    encoded = pa.concat_arrays(words).dictionary_encode()
    return encoded, np.concatenate(counts).astype(np.int64), np.concatenate([plain, rest, empty])


def _dealt(block: pa.Table, specials: list[str], parts: int) -> tuple[pa.Array, np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of a block in order of (part, word), their parts, and of its words, as in _words: index, counts, rows."""
    encoded, counts, rows = _words(block.column("text").combine_chunks(), specials)
    words = encoded.dictionary
    part = (hashing.value_hashes(words) % np.uint64(parts)).astype(np.int64)
    order = pc.sort_indices(pa.table({"part": part, "word": words}), [("part", "ascending"), ("word", "ascending")]).to_numpy()
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    return words.take(pa.array(order)), part[order], place[encoded.indices.to_numpy()], counts, rows


def _exact(word: str) -> str:
    return word[1:] if word[:1] == _EXACT else " " + word


def _ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[starts[i] : starts[i] + lengths[i]] for all i, one after another."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    at = np.arange(int(ends[-1]) if len(ends) else 0)
    return values[at + np.repeat(starts - (ends - lengths), lengths)]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids array<int> of each row of ``docs`` (doc_id, text, any others); a null text counts as empty.

    Ids are those of the tokenizer file with special tokens of a text recognised and none added.
    Every distinct word of the corpus is encoded once, in the part of its hash. Rows that repeat get
    equal ids, a null doc_id stays null, an empty table gives no rows.
    """
    path = path or default_tokenizer()
    specials = [t.content for t in tokenizer(path).get_added_tokens_decoder().values()]

    parts, _ = dictionary_parts(docs)

    def keep(block: pa.Table) -> bytes:
        _, part, index, counts, rows = _dealt(block, specials, parts)
        ids = block.column("doc_id").combine_chunks().take(pa.array(rows))
        known = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        return pack_arrays(index, counts, ids.fill_null(0).to_numpy(), known, np.unique(part))

    def cells(block: pa.Table) -> Iterator[tuple[int, bytes]]:
        words, part, *_ = _dealt(block, specials, parts)
        for p, start, end in zip(*_runs(part), strict=True):
            own = words.slice(start, end - start).cast(pa.large_binary())
            lengths = pc.binary_length(own).to_numpy().astype(np.uint32)
            yield p, pack_arrays(lengths, np.frombuffer(b"".join(own.to_pylist()), np.uint8))

    def resolve(payloads: list[bytes]) -> list[bytes]:
        arrays = []
        for data in payloads:
            lengths, raw = unpack_arrays(data)
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            arrays.append(pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends), pa.py_buffer(raw.tobytes())))
        table = pa.concat_arrays(arrays).dictionary_encode()
        ids = encode_words([_exact(w) for w in table.dictionary.to_pylist()], path)
        lengths = np.array([len(i) for i in ids], np.uint32)
        narrow = np.uint16 if max(map(len, ids), default=0) < 1 << 16 else np.uint32  # a word may be a whole text
        kind = np.uint16 if max(map(max, filter(None, ids)), default=0) < 1 << 16 else np.uint32
        flat = np.fromiter((i for own in ids for i in own), kind, int(lengths.sum()))
        del ids
        starts = np.cumsum(lengths, dtype=np.int64) - lengths
        index, at, out = table.indices.to_numpy(), 0, []
        for a in arrays:
            own = index[at : at + len(a)]
            out.append(pack_arrays(lengths[own].astype(narrow), _ragged(flat, starts[own], lengths[own]), planes=False))
            at += len(a)
        return out

    def finish(kept: bytes, answers: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        word, counts, doc, known, used = unpack_arrays(kept)
        if not set(used.tolist()) <= answers.keys():
            raise RuntimeError("a block and its answers were made from different rows")
        got = [unpack_arrays(answers[p]) for p in used.tolist()]
        lengths = np.concatenate([np.zeros(0, np.uint32), *(g[0] for g in got)]).astype(np.int64)
        flat = np.concatenate([np.zeros(0, np.uint16), *(g[1] for g in got)])
        starts = np.cumsum(lengths) - lengths
        first = np.concatenate([[0], np.cumsum(counts)])
        ids = pa.array(doc, mask=known == 0)
        for lo in range(0, len(doc), 200):
            hi = min(lo + 200, len(doc))
            own = word[first[lo] : first[hi]]
            ends = np.concatenate([[0], np.cumsum(lengths[own])])[first[lo : hi + 1] - first[lo]]
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(_ragged(flat, starts[own], lengths[own]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), lists], ["doc_id", "ids"])

    return through_dictionary(docs, parts, keep, cells, resolve, finish, "doc_id long, ids array<int>")


def _runs(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Values, starts and ends of the runs of equal values."""
    if not len(sorted_values):
        return [], [], []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(sorted_values)) + 1])
    return sorted_values[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(sorted_values)]


def piece_table(path: str) -> list[bytes]:
    """The bytes of each id, by id. The vocabulary file bounds its size."""
    byte = {c: b for b, c in BYTE_LETTERS.items()}
    t = tokenizer(path)
    out = [b""] * t.get_vocab_size()
    for piece, i in t.get_vocab().items():
        out[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
    return out


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``encoded`` (doc_id, ids, any others) with the text of its ids: each id joined to its piece, in order.

    Null ids give an empty text, as do ids outside the vocabulary; bytes that are not UTF-8 become U+FFFD.
    """
    path = path or default_tokenizer()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw, begins, sizes = piece_table_arrays(path)
        column = batch.column("ids")
        lists = column.fill_null([]) if column.null_count else column
        first = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
        start = 0
        while start < batch.num_rows:  # a run of rows with about RUN ids, so that bytes of few texts are laid out at once
            end = max(start + 1, int(np.searchsorted(first, first[start] + RUN, side="right")) - 1)
            ids = lists.slice(start, end - start).flatten().to_numpy(zero_copy_only=False)
            ids = np.where((ids >= 0) & (ids < len(sizes)), ids, len(sizes) - 1)
            lengths = sizes[ids]
            data = _ragged(raw, begins[ids], lengths).tobytes()
            ends = np.concatenate([[0], np.cumsum(lengths)])[first[start : end + 1] - first[start]]
            texts = [data[x:y].decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:], strict=True)]
            own = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(texts, pa.string())], [*own.schema.names, "text"])
            start = end

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.drop("text").schema.fields)
    return encoded.drop("text").mapInArrow(per_batch(run), kinds + ", text string")


_pieces: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def piece_table_arrays(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces' bytes in one array, their starts and lengths; a last, empty piece stands for unknown ids."""
    if path not in _pieces:
        table = [*piece_table(path), b""]
        forget(path)
        lengths = np.array([len(p) for p in table])
        _pieces[path] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(lengths) - lengths, lengths
    return _pieces[path]
