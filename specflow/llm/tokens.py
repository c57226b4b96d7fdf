"""Token ids and token counts of whole texts, with one library call per new chunk.

A text is cut at *safe boundaries*: places where the tokenizer's own
pre-tokenization always cuts, so the ids of the text are the ids of its
chunks in order.  Repeated chunks are encoded once per Python worker (a
bounded cache).  Two families of vocabulary files are known:

``word``  white space is dropped and letters are lower-cased by the file's
          normalizer; every ASCII white space is a safe boundary.  ASCII chunks
          without ``<|`` are lower-cased before they are looked up.
``byte``  byte-level files; the place before a single space that follows and
          precedes other characters is a safe boundary.  Texts with runs of
          white space are cut by a stricter rule only.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import large, string_bytes

#: Chunks in each of the two generations of a worker's cache; longer chunks are not kept.
CACHE_CHUNKS, CACHE_CHARS = 450_000, 48
#: ASCII marks that end a chunk and, after a letter or digit, always start a new
#: pre-token. Apostrophes (contractions) and <|> (special strings) are left out.
_TAIL = "!\"#$%&()*+,-./:;=?@[]^_`{}~"
_LETTER = r"[\pL0-9]$"
#: The start of a chunk that may follow others in one text.
_JOINT = re.compile(r" (?:[!-~]|[^\W_])")
_STRICT = re.compile(r"(?<=[A-Za-z0-9.,])(?= [A-Za-z0-9])")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@functools.lru_cache(maxsize=4)
def family(path: str) -> str:
    """``word``, ``byte`` or ``whole`` (an unknown file: texts are never cut)."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    norm, pre = j.get("normalizer"), j.get("pre_tokenizer") or {}
    kinds = [n["type"] for n in (norm or {}).get("normalizers", [])]
    if norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex"):
        return "byte"
    if kinds == ["NFC", "Replace", "Lowercase"] and j["model"].get("end_of_word_suffix"):
        return "word"
    return "whole"


@functools.lru_cache(maxsize=4)
def _cache(path: str) -> list[dict[str, bytes]]:
    """The young generation and the old one."""
    return [{}, {}]


@functools.lru_cache(maxsize=4)
def _byte_lengths(path: str) -> np.ndarray | None:
    """UTF-8 bytes of each id of a byte-level file; None for others, or where a special string may reach across a boundary."""
    if family(path) != "byte":
        return None
    with open(path, encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") or any(c.isspace() for c in a["content"]) for a in added):
        return None
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    size = np.zeros(max(vocab.values(), default=-1) + 1, np.int64)
    size[list(vocab.values())] = list(map(len, vocab))  # a character of the vocabulary is a byte
    for a in added:
        size[a["id"]] = len(a["content"].encode())
    return size


def _side_by_side(path: str, chunks: list[str]) -> list[bytes] | None:
    """ids of chunks encoded as one text and cut by their ids' bytes; each starts with a space before a printed character and ends
    in a letter or digit, so the tokenizer cuts between them.  None where the ids' bytes don't meet the chunks' ends."""
    size, joined = _byte_lengths(path), "".join(chunks)
    ids = np.array(tokenizer(path).encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
    ends = np.cumsum(np.fromiter(map(len, chunks if joined.isascii() else map(str.encode, chunks)), np.int64, len(chunks)))
    have = np.cumsum(size[ids])
    at = np.searchsorted(have, ends)
    if not len(ids) or have[-1] != ends[-1] or (have[at] != ends).any():
        return None
    raw, cuts = ids.tobytes(), [0, *(4 * (at + 1)).tolist()]
    return [raw[lo:hi] for lo, hi in itertools.pairwise(cuts)]


def _apart(path: str, chunks: list[str]) -> list[bytes]:
    """ids of each chunk as a text of its own."""
    return [array("I", e.ids).tobytes() for e in tokenizer(path).encode_batch_fast(chunks, add_special_tokens=False)]


def _lookup(path: str, uniq: list[str]) -> list[bytes]:
    """ids (little-endian uint32) of different chunks, new ones by the library."""
    gens = _cache(path)
    if len(gens[0]) > CACHE_CHUNKS:
        gens[:] = {}, gens[0]
    cache, old = gens
    found = list(map(cache.get, uniq))
    new = [i for i, x in enumerate(found) if x is None]
    if old:
        for i in new:
            if (x := old.get(uniq[i])) is not None:
                found[i] = cache[uniq[i]] = x
        new = [i for i in new if found[i] is None]
    alone = new
    if new and _byte_lengths(path) is not None:
        joint, alone = [], []
        for i in new:
            (joint if _JOINT.match(uniq[i]) and uniq[i][-1].isalnum() else alone).append(i)
        for lo in range(0, len(joint), 4096):
            part = joint[lo:lo + 4096]
            got = _side_by_side(path, [uniq[i] for i in part])
            if got is None:
                alone += part
                continue
            for i, ids in zip(part, got):
                found[i] = ids
    for lo in range(0, len(alone), 4096):
        part = alone[lo:lo + 4096]
        for i, ids in zip(part, _apart(path, [uniq[i] for i in part])):
            found[i] = ids
    for i in new:
        if len(uniq[i]) <= CACHE_CHARS:
            cache[uniq[i]] = found[i]
    return found


def _gather(flat: np.ndarray, lens: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ``flat`` (run i has ``lens[i]`` items) in the order of ``codes``, and their offsets."""
    n = lens[codes]
    dst = np.r_[0, np.cumsum(n)].astype(np.int64)
    src = np.r_[0, np.cumsum(lens)][:-1][codes]
    return flat[np.arange(dst[-1]) + np.repeat(src - dst[:-1], n)], dst


@functools.lru_cache(maxsize=4)
def _kept(path: str) -> dict[str, bool]:
    """By last character of a chunk; at most one entry for each code point."""
    return {}


def _ends_in_letter(path: str, stem: pa.Array) -> pa.Array:
    """Whether the file's normalizer leaves a letter or digit at a chunk's end: it may put a combining
    mark there instead (a capital with a dot, letters that NFC takes apart), which joins marks behind it."""
    last, kept = pc.utf8_slice_codeunits(stem, start=-1).dictionary_encode(), _kept(path)
    chars = last.dictionary.to_pylist()
    new = [c for c in chars if c not in kept]
    if new:
        normal = tokenizer(path).normalizer
        ends = pa.array([normal.normalize_str(c) for c in new], pa.string())
        kept.update(zip(new, pc.match_substring_regex(ends, _LETTER).to_pylist()))
    return pa.array([kept[c] for c in chars], pa.bool_()).take(last.indices)


def _unique_ids(path: str, uniq: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all different chunks one after another, their lengths).  A chunk
    is looked up as its stem and the marks behind it."""
    if family(path) == "whole":
        ids = _lookup(path, uniq.to_pylist())
        return np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    if family(path) == "word":
        # not where a special string, matched on raw text, may arise, nor before NFC has composed letters
        plain = pc.and_not(pc.string_is_ascii(uniq), pc.match_substring(uniq, "<|"))
        uniq = pc.if_else(plain, pc.ascii_lower(uniq), uniq)
    stem = pc.utf8_rtrim(uniq, _TAIL)
    ok = pc.match_substring_regex(stem, _LETTER)
    if family(path) == "word":
        ok = pc.and_(ok, _ends_in_letter(path, stem))
    stem = pc.if_else(ok, stem, uniq)
    start = pc.binary_length(stem).to_numpy(zero_copy_only=False)
    tails = pc.dictionary_encode(pc.if_else(ok, _suffix(uniq, start), pa.scalar("", pa.large_string())))
    stems = pc.dictionary_encode(stem)
    parts = stems.dictionary.to_pylist() + tails.dictionary.to_pylist()
    ids = _lookup(path, parts)
    lens = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    codes = np.empty(2 * len(uniq), np.int64)
    codes[0::2] = stems.indices.to_numpy(zero_copy_only=False)
    codes[1::2] = tails.indices.to_numpy(zero_copy_only=False) + len(stems.dictionary)
    flat, off = _gather(np.frombuffer(b"".join(ids), "<u4"), lens, codes)
    return flat, np.diff(off[::2])


def _suffix(col: pa.Array, start: np.ndarray) -> pa.Array:
    """Each string from its byte ``start`` on (a character's first byte)."""
    off, raw = string_bytes(col)
    n = np.diff(off) - start
    out = np.r_[0, np.cumsum(n)]
    at = np.arange(out[-1]) + np.repeat(off[:-1] + start - out[:-1], n)
    return pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(out.astype(np.int64)), pa.py_buffer(raw[at].tobytes()))


def _chunks(path: str, col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All chunks of a slice of texts, and each text's first chunk."""
    kind = family(path)
    if kind == "whole":
        return col, np.arange(len(col) + 1)
    if kind == "word":
        for ch in "\n\t\r":
            col = pc.replace_substring(col, ch, " ")
        pieces = pc.split_pattern(col, " ")
        return pieces.values, pieces.offsets.to_numpy()
    # white space beside white space or beside rare characters: the strict rule
    odd = pc.match_substring_regex(col, r"\s\s|\s$|^\s|[\x00\x1c-\x1f\v\f]|[^\x00-\x7f\pL\pP]\s|\s[\pM\pZ\pC]").to_numpy(zero_copy_only=False)
    pieces = pc.split_pattern(pc.replace_substring(col, " ", "\x00 "), "\x00")
    off, joined = pieces.offsets.to_numpy(), pieces.values
    if not odd.any():
        return joined, off
    out, sizes = [], np.diff(off)
    plain = joined.to_pylist()
    texts = col.to_pylist()
    for i, o in enumerate(odd):
        cs = _STRICT.split(texts[i]) if o else plain[off[i]:off[i + 1]]
        sizes[i] = len(cs)
        out += cs
    return pa.array(out, pa.large_string()), np.r_[0, np.cumsum(sizes)]


def _coded(path: str, col: pa.Array):
    texts, off = _chunks(path, col)
    d = texts.dictionary_encode()
    codes = d.indices.to_numpy(zero_copy_only=False)
    flat, lens = _unique_ids(path, large(d.dictionary))
    return flat, lens, codes, off


def count_tokens(path: str, col: pa.Array) -> np.ndarray:
    """Tokens of each text of a slice (large strings without nulls)."""
    _, lens, codes, off = _coded(path, col)
    total = np.r_[0, np.cumsum(lens[codes])]
    return total[off[1:]] - total[off[:-1]]


def encode(path: str, col: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts one after another, offsets of the texts), each text
    closed by ``end_id`` if given."""
    flat, lens, codes, off = _coded(path, col)
    out, dst = _gather(flat, lens, codes)
    doc = dst[off]
    if end_id is None:
        return out, doc
    full = np.empty(len(out) + len(col), dtype="<u4")
    ends = doc[1:] + np.arange(len(col))
    keep = np.ones(len(full), bool)
    keep[ends] = False
    full[ends] = end_id
    full[keep] = out
    return full, np.r_[0, ends + 1]
