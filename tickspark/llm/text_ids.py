"""Token ids of whole texts with the tokenizers library, encoding each distinct space-led word once.

A byte-level tokenizer of the usual kind encodes pre-tokens independently, and a space between two words always
starts a pre-token, as does a line feed between them.  So the ids of a text are those of its words put together: Arrow cuts the texts of a batch and
numbers the distinct words, the library encodes the new ones, numpy lays their ids out.  Texts in which a space stands
next to other white space in a way that matters, or that hold the string of a special token, go to the library whole, as
do all texts if the tokenizer file names another pre-tokenizer or a normaliser.  A worker remembers
words up to a bound in bytes and then forgets those that a run of texts does not hold, which only costs time.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._common import worker_object

#: White space of the pre-token pattern, as a character class.
_WHITE = "[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: A space that need not start a pre-token of its own: white space before it and after it, or nothing after it.
_INSIDE_RUN = f"{_WHITE} {_WHITE}| \\z|\\x00"
#: A line feed that may be in one pre-token with other white space; any other is one of its own.
_LINE_RUN = f"\\n{_WHITE}|{_WHITE}\\n|\\n\\z|\\A\\n"
#: What stands before a word after a line feed instead of a space; texts that hold it go to the library whole.
_AFTER = "\x00\n"
#: A word and marks after it, which are two pre-tokens; an apostrophe is no mark, as it may begin one with letters.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKED = re.compile(f"([A-Za-zÀ-ÖØ-öø-ÿ]+)([{re.escape(_MARKS)}]+)").fullmatch


def load_tokenizer(path: str, threads: int = 1):
    """The tokenizer in a file, with the library's own handling of special tokens."""
    os.environ["RAYON_NUM_THREADS"] = str(threads)
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def splits_at_spaces(settings: dict) -> bool:
    """Whether a tokenizer file's settings are those of a byte-level BPE that cuts by the usual pattern and alters no text."""
    cut, model = settings["pre_tokenizer"] or {}, settings["model"]
    own = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
    bare = not any(t["lstrip"] or t["rstrip"] or t["normalized"] for t in settings["added_tokens"])
    return bool(own and bare and settings["normalizer"] is None and model["type"] == "BPE" and not model.get("dropout"))


class TextEncoder:
    """Encodes texts to unsigned 32-bit ids, as `tokenizer.encode(text, add_special_tokens=False)` does."""

    def __init__(self, tokenizer, max_bytes: int = 100_000_000):
        self.tokenizer, self.max_words = tokenizer, max_bytes // 200  # a word and its ids take about 200 bytes
        settings = json.loads(tokenizer.to_str())
        self.known, self.added = splits_at_spaces(settings), [t["content"] for t in settings["added_tokens"]]
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a vocabulary string has one character for each byte
        for token, i in vocabulary.items():
            self.n_bytes[i] = len(token)
        self.memo: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Words go to the library as one text, each led by a space or a line feed, whose ids are cut where their bytes end; those that begin or end with white space go one by one."""
        memo, marks = self.memo, self.marks
        marked, loose, new = [], [], []
        for x in words:
            if x[-1:] in _MARKS and (found := _MARKED(x.removeprefix(_AFTER))):
                tail = found[2]
                marked.append((x, x[: -len(tail)], tail))
            elif not x or x[0].isspace() or x[-1].isspace():
                loose.append(x)
            else:
                new.append(x)
        new += {x for _, x, _ in marked}.difference(new, memo)
        memo.update(zip(loose, self._whole([" " + x if x[:2] != _AFTER else x[1:] for x in loose])))
        self._joined(" ", [x for x in new if x[:2] != _AFTER], 0)
        self._joined("\n", [x for x in new if x[:2] == _AFTER], 2)
        tails = list({x for _, _, x in marked}.difference(marks))
        if len(marks) > 10_000:
            marks.clear()
            tails = list({x for _, _, x in marked})
        marks.update(zip(tails, self._whole(tails)))
        for x, word, tail in marked:
            memo[x] = memo[word] + marks[tail]

    def _joined(self, lead: str, words: list[str], skip: int) -> None:
        """Learns words, less their first `skip` characters, that stand after that white space."""
        memo = self.memo
        for at in range(0, len(words), 1024):
            part = words[at : at + 1024]
            (data,) = self._whole([lead + lead.join([x[skip:] for x in part] if skip else part)])
            sizes = np.asarray(pc.binary_length(pa.array(part, pa.string()))) - (skip - 1)
            ends = 4 * (1 + np.searchsorted(np.cumsum(self.n_bytes[np.frombuffer(data, "<u4")]), np.cumsum(sizes)))
            begin = 0
            for x, end in zip(part, ends.tolist()):
                memo[x] = data[begin:end]
                begin = end

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each) of an array without nulls."""
        odd = pc.match_substring_regex(texts, _INSIDE_RUN)
        for token in self.added:
            odd = pc.or_(odd, pc.match_substring(texts, token))
        odd = np.asarray(odd) if self.known else np.ones(len(texts), bool)
        if not odd.any():
            return self._encode_cut(texts)
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist())
        ids, n = self._encode_cut(texts.filter(pa.array(~odd)))
        cut = iter(np.split(ids, np.cumsum(n)[:-1]))
        rows = [np.frombuffer(whole.pop(0), "<u4") if x else next(cut) for x in odd.tolist()]
        return np.concatenate(rows), np.array([len(x) for x in rows], np.int64)

    def _encode_cut(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        lines = pc.if_else(pc.match_substring_regex(texts, _LINE_RUN), texts, pc.replace_substring(texts, "\n", " " + _AFTER))
        cut = pc.split_pattern(lines, " ")
        bounds = np.asarray(cut.offsets).astype(np.int64)
        numbered = cut.flatten().dictionary_encode()
        # the first word of a text has no space before it
        heads = self._whole(pc.list_element(cut, 0).to_pylist())
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.memo) > self.max_words:  # the words that go on to occur stay
            self.memo = {x: self.memo[x] for x in words if x in self.memo}
        memo = self.memo
        missing = [x for x in words if x not in memo]
        if missing:
            self._learn(missing)
        data = pa.array([*map(memo.__getitem__, words), *heads], pa.binary())
        starts = np.frombuffer(data.buffers()[1], np.int32) // 4
        sizes = np.diff(starts).astype(np.int64)
        place = np.asarray(numbered.indices).astype(np.int64)
        bounds -= bounds[0]
        place[bounds[:-1]] = len(words) + np.arange(len(heads))
        n = sizes[place]
        ends = np.cumsum(n)
        at = np.repeat(starts[place] - ends + n, n)
        at += np.arange(len(at))
        ids = np.frombuffer(data.buffers()[2], "<u4") if len(at) else np.zeros(0, "<u4")
        return ids[at], np.add.reduceat(n, bounds[:-1])

    def encode_rows(self, texts: pa.StringArray, max_bytes: int = 12_000_000) -> Iterator[bytes]:
        """The ids of each text as little-endian bytes; a run of texts with at most so many bytes (one text at least) is held at a time."""
        ends = np.cumsum(np.asarray(pc.binary_length(texts)).astype(np.int64))
        begin = 0
        while begin < len(texts):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
            ids, n = self.encode(texts.slice(begin, end - begin))
            data, at = ids.tobytes(), 0
            for size in (4 * n).tolist():
                yield data[at : at + size]
                at += size
            begin = end


def worker_encoder(path: str) -> TextEncoder:
    """The worker's encoder for a file."""
    return worker_object(("ids", path), lambda: TextEncoder(load_tokenizer(path)))
