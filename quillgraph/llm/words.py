"""Texts to ids by way of their distinct words, for tokenizers whose tokens never cross white space.

A batch of texts is put in lower case, cut at white space and before marks that follow a letter, and its distinct
chunks are numbered, all in Arrow. Only distinct chunks are looked up one by one, in a table of two generations: what
was used lately stays, the rest goes, and whatever is gone is encoded again with the same result. Ids of whole texts
are then gathered from the table's arrays in numpy. Memory is bounded whatever the vocabulary, and texts of any
length go in parts of about ``PART`` bytes, cut at white space.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from quillgraph.llm.common import strings

#: White space as the Unicode property has it, beyond ASCII's; U+001C to U+001F are ordinary here.
SPACE = "\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A mark of ASCII after a letter or digit always begins a word. U+0130, whose small form ends in a mark, and letters beyond U+024F are left to the word pattern.
MARK = r"([0-9a-zÀ-ÖØ-öø-įı-ɏ])([!-/:-@\[-`{-~])"
#: How many chunks a generation keeps, from what length on none is kept, ids a chunk on average, and bytes of a part.
KEPT, LONG, IDS_KEPT, PART = 100_000, 100, 16, 4_000_000


class Table:
    """Ids by key: a dict of rows, and the rows' ids end to end."""

    def __init__(self):
        self.row: dict[str, int] = {}
        self.begin, self.count, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), 0
        self.ids, self.filled = np.zeros(4096, np.uint32), 0

    def add(self, keys: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        """New keys with their ids end to end, so many of each."""
        rows, filled = self.used + len(keys), self.filled + len(ids)
        if rows > len(self.begin):
            self.begin, self.count = (np.concatenate([x[: self.used], np.zeros(2 * rows - self.used, np.int64)]) for x in (self.begin, self.count))
        if filled > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.filled], np.zeros(2 * filled - self.filled, np.uint32)])
        ends = np.cumsum(counts)
        self.begin[self.used : rows] = self.filled + ends - counts
        self.count[self.used : rows] = counts
        self.ids[self.filled : filled] = ids
        self.row.update(zip(keys, range(self.used, rows)))
        self.used, self.filled = rows, filled

    def rows(self, keys: list[str]) -> np.ndarray:
        """The row of each key, -1 for none."""
        return np.fromiter(map(self.row.get, keys, repeat(-1)), np.int64, len(keys))

    def lacks(self, keys: list[str]) -> list[str]:
        return list(compress(keys, (self.rows(keys) < 0).tolist()))

    def gather(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the rows' ids end to end, how many each has)."""
        counts = self.count[rows]
        ends = np.cumsum(counts)
        kind = np.int32 if len(rows) and max(int(ends[-1]), self.filled) < 2**31 else np.int64
        at = np.repeat((self.begin[rows] - ends + counts).astype(kind), counts)
        at += np.arange(len(at), dtype=kind)
        return self.ids[at], counts


def packed(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of little-endian unsigned 32-bit ids; each row's end at these places."""
    offsets = np.concatenate([[0], 4 * ends])
    wide = offsets[-1] >= 2**31
    out = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
    return out.cast(pa.binary()) if wide else out


def parts(texts: pa.Array, size: int = PART) -> Iterator[tuple[pa.Array, bool]]:
    """The texts of a column in turn (nulls are empty), a few at a time or one in parts, cut at a space, and whether the last one given goes on."""
    column = strings(texts)
    offsets, data = np.frombuffer(column.buffers()[1], np.int64), column.buffers()[2]
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        if end > at + 1 or offsets[end] - offsets[at] <= size:
            yield strings(column, at, end), False
        else:
            begin, stop = int(offsets[at]), int(offsets[end])
            while begin < stop:
                # without any space the part grows to the next one
                cut = min(begin + size, stop)
                while cut < stop:
                    found = data.slice(cut, min(size, stop - cut)).to_pybytes().find(b" ")
                    if found >= 0:
                        cut += found + 1
                        break
                    cut = min(cut + size, stop)
                yield pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, cut - begin], np.int64)), data.slice(begin, cut - begin)]), cut < stop
                begin = cut
        at = end


class WordEncoder:
    """Ids of whole texts. ``encode_words`` gives (ids end to end, how many each has) of words."""

    def __init__(self, path: str, encode_words: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], kept: int = KEPT):
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self._special = "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))
        newer = _unassigned()
        letter, number = (rf"[\p{{{kind}}}--[{newer}]]" if newer else rf"\p{{{kind}}}" for kind in "LN")
        self._word = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|{letter}+|{number}|[[^{SPACE}\t-\r \p{{L}}\p{{N}}]{newer}]+")
        self._normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.encode_words, self.kept = encode_words, kept
        self.table, self.old = Table(), Table()
        self._long: list[str] = []

    def words_of(self, chunk: str) -> list[str]:
        """The words of a chunk in lower case and composed form."""
        if not chunk or chunk.isalpha():
            return [chunk] if chunk else []
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self._word.findall(chunk)

    def _add(self, words: list[str]) -> None:
        """Encode words, or take what the older table has of them."""
        rows = self.old.rows(words)
        if (rows >= 0).any():
            known = (rows >= 0).tolist()
            self.table.add(list(compress(words, known)), *self.old.gather(rows[rows >= 0]))
            words = list(compress(words, (rows < 0).tolist()))
        if words:
            self.table.add(words, *self.encode_words(words))
            if max(map(len, words)) > LONG:
                self._long += [w for w in words if len(w) > LONG]

    def _learn(self, keys: list[str]) -> None:
        """Give the table these distinct chunks, none of which it has."""
        rows = self.old.rows(keys)
        if (rows >= 0).any():
            known = (rows >= 0).tolist()
            self.table.add(list(compress(keys, known)), *self.old.gather(rows[rows >= 0]))
            keys = list(compress(keys, (rows < 0).tolist()))
        column = pa.array(keys, pa.large_string())
        letters, ascii_ = pc.utf8_is_alpha(column), pc.string_is_ascii(column)
        small = pc.and_(pc.and_(letters, ascii_), pc.equal(column, pc.ascii_lower(column))).to_pylist()
        self._add(list(compress(keys, small)))  # nearly all chunks are words as they stand
        keys = [k for k, s in zip(keys, small) if not s]
        if not keys:
            return
        # white space never takes part in composition, so many chunks are normalised as one text
        words = [self.words_of(c) for c in self._normal("\n".join(keys)).split("\n")]
        wanted = list(dict.fromkeys(chain.from_iterable(words)))
        if wanted:
            self._add(self.table.lacks(wanted))
        joined = [(k, w) for k, w in zip(keys, words) if w != [k]]
        if joined:
            ids, counts = self.table.gather(self.table.rows(list(chain.from_iterable(w for _, w in joined))))
            # a chunk may have no word at all
            ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([len(w) for _, w in joined])]
            self.table.add([k for k, _ in joined], ids, np.diff(ends, prepend=0))

    def _plain(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of texts without special tokens."""
        if len(self.table.row) > self.kept or self.table.filled > IDS_KEPT * self.kept:
            self.old, self.table = self.table, Table()
        low = pc.ascii_lower(column)
        # a small letter may join with a mark that leaves the capital alone, and marks join before letters become small
        joining = pc.match_substring_regex(column, r"[A-Z]\p{M}")
        if pc.any(joining).as_py():
            low = pc.if_else(joining, column, low)
        if pc.any(pc.match_substring_regex(low, f"[{SPACE}]")).as_py():
            low = pc.replace_substring_regex(low, f"[{SPACE}]", " ")
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(low, MARK, r"\1 \2"))
        # white space at the ends gives empty chunks
        numbered = split.flatten().dictionary_encode()
        keys = numbered.dictionary.to_pylist()
        rows = self.table.rows(keys)
        unknown = rows < 0
        if unknown.any():
            new = list(compress(keys, unknown.tolist()))
            self._learn(new)
            rows[unknown] = self.table.rows(new)
            if max(map(len, new)) > LONG:
                self._long += [k for k in new if len(k) > LONG]
        ids, counts = self.table.gather(rows[numbered.indices.to_numpy()])
        ends = np.concatenate([[0], np.cumsum(counts)])
        offsets = split.offsets.to_numpy()
        for k in self._long:
            self.table.row.pop(k, None)
        self._long = []
        return ids, ends[offsets[1:] - offsets[0]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, where each text's end); null texts have none."""
        column = strings(texts)
        if not self._special or not pc.any(pc.match_substring_regex(column, self._special)).as_py():
            return self._plain(column)
        # texts are cut at special tokens, whose strings become those tokens
        pieces, last = [], []
        for text in column.to_pylist():
            pieces += regex.split(f"({self._special})", text)
            last.append(len(pieces) - 1)
        marks = np.array([self.special.get(p, -1) for p in pieces], np.int64)
        ids, ends = self._plain(pa.array(["" if m >= 0 else p for p, m in zip(pieces, marks)], pa.large_string()))
        at = (marks >= 0).nonzero()[0]
        ids = np.insert(ids, ends[at], marks[at].astype(np.uint32))
        return ids, (ends + np.cumsum(marks >= 0))[last]


def _unassigned() -> str:
    """Code points that the pattern library counts as letters or numbers while the tokenizers library, with older tables, does not."""
    import unicodedata

    from tokenizers import Regex, pre_tokenizers

    newer = regex.compile(r"[\p{L}\p{N}]")
    doubtful = "".join(c for c in map(chr, range(0x500, 0x34000)) if not 0xD800 <= ord(c) < 0xE000 and unicodedata.category(c) == "Cn" and newer.match(c))
    return "".join(part for part, _ in pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]+"), "removed").pre_tokenize_str(doubtful))
