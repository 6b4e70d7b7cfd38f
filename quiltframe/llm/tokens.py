"""Token counts by a whole-token shortcut.

A byte-level BPE with the usual pre-tokenizer never joins a space that stands before a
non-space character to what precedes it. A text is therefore the concatenation of its units: the
pieces that begin at such spaces. Which vocabulary strings encode alone as exactly one token is
proved once, on the driver, by encoding each of them; a unit that is one of those counts 1
without any merging. Only the remaining units go through the merges, once per worker as long as
they stay in a bounded cache; those of the form word and punctuation by these two pre-tokens.
Where the file's merges stand in the order of their ids (checked on the driver) merging goes by
rank, which is then the same rule; else the library merges. Texts that hold special strings, or
a space between two white spaces (where the rule above doesn't cut), are encoded whole by the
library.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters a worker splits at once, entries its cache may hold.
SEGMENT, CACHE = 1 << 20, 600_000
_UNSAFE = re.compile(r"\s (?:\s|\Z)")
_WORD = re.compile(r"([^\W\d_]+)([^\w\s']*)")
#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def special_strings(path: str) -> list[str]:
    return [a.content for a in library(path).get_added_tokens_decoder().values()]


def proven(path: str) -> dict[str, int]:
    """The strings that the tokenizer encodes alone as one token of its model, with their ids."""
    t = library(path)
    special = set(special_strings(path))
    ids = range(t.get_vocab_size(with_added_tokens=False))
    strings = [t.decode([i], skip_special_tokens=False) for i in ids]
    out = {}
    for s, e in zip(strings, t.encode_batch(strings, add_special_tokens=False)):
        if len(e.ids) == 1 and s not in special and "�" not in s:
            out[s] = e.ids[0]
    return out


def byte_of() -> dict[str, int]:
    """The bytes behind the printable stand-ins of byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary as merge ranks, or None where ids don't follow the order of the merges."""
    import json

    spec = json.loads(Path(path).read_text("utf-8"))
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["normalizer"]
    if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "unk_token")):
        return None
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    vocab, chars = model["vocab"], byte_of()
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(pairs)):
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    return {bytes(chars[c] for c in s): i for s, i in vocab.items() if s not in special}


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """``text`` in parts of about ``size`` characters, cut before single spaces between other characters."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(" ", cut)) > 0 and (cut + 1 >= len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Encoder:
    """Maps texts to a fold of their ids; ``of`` gives the value of a unit's ids, ``fold`` joins the values."""

    def __init__(self, path: str, known: tuple[dict[str, int], dict[bytes, int] | None], of: Callable[[list[int]], object], fold: Callable):
        whole, by_rank = known
        self.lib, self.of, self.fold, self.merge = library(path), of, fold, None
        self.special = special_strings(path)
        if by_rank is not None:
            import tiktoken

            self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=by_rank, special_tokens={})
        self.marks: dict[str, list[int]] = {}
        # units are looked up as split at " ", so without their leading space
        self.base = {s[1:]: of([i]) for s, i in whole.items() if s[:1] == " " and " " not in s[1:]}
        self.first = {s: of([i]) for s, i in whole.items() if " " not in s} | {"": of([])}
        self.seen = dict(self.base)
        self.words: dict[str, list[int]] = {s[1:]: [i] for s, i in whole.items() if s[:1] == " " and s[1:].isalpha()}
        self.n_words = len(self.words)

    def _units(self, units: list[str]) -> list:
        """The values of units, each with its leading space."""
        if self.merge is None:
            return [v for lo in range(0, len(units), 4096) for v in self._encode([" " + u for u in units[lo : lo + 4096]])]
        piece, words, marks, of, match = self.merge._encode_single_piece, self.words, self.marks, self.of, _WORD.fullmatch
        if len(words) > CACHE + self.n_words or len(marks) > CACHE:
            self.words = words = {k: v for k, v in list(words.items())[: self.n_words]}
            self.marks = marks = {}
        out = []
        for u in units:
            m = match(u)
            if m and (w := m[1]).isalpha():
                ids = words.get(w)
                if ids is None:
                    ids = words[w] = piece(" " + w)
                if t := m[2]:
                    more = marks.get(t)
                    if more is None:
                        more = marks[t] = piece(t)
                    ids = ids + more
                out.append(of(ids))
            else:
                out.append(of(self.merge.encode_ordinary(" " + u)))
        return out

    def _encode(self, texts: list[str]) -> list:
        return [self.of(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, text: str) -> bool:
        return not _UNSAFE.search(text) and not any(s in text for s in self.special)

    def __call__(self, texts: list[str]) -> list:
        out = []
        for lo in range(0, len(texts), 256):
            out += self._some([list(segments(t)) if len(t) > SEGMENT and not any(s in t for s in self.special) else [t] for t in texts[lo : lo + 256]])
        return out

    def _some(self, parts: list[list[str]]) -> list:
        split = [[p.split(" ") if self._plain(p) else p for p in t] for t in parts]
        fresh = {u for t in split for p in t if type(p) is list for u in p[1:]}
        fresh = [u for u in fresh if u not in self.seen]
        if len(self.seen) + len(fresh) > CACHE + len(self.base):
            self.seen = dict(self.base)
            fresh = list({u for t in split for p in t if type(p) is list for u in p[1:]} - self.seen.keys())
        self.seen.update(zip(fresh, self._units(fresh)))
        get = self.seen.__getitem__
        out = []
        for t in split:
            values = []
            for p in t:
                if type(p) is list:
                    head = p[0]
                    values.append(self.first[head] if head in self.first else self._encode([head])[0])
                    values.extend(map(get, p[1:]))
                else:
                    values.append(self._encode([p])[0])
            out.append(self.fold(values))
        return out


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of each row, in whole texts and as the library counts without added tokens.

    Special strings inside a text are handled as the library does by default. Null texts are
    empty; ids may repeat or be null. ``path`` must exist on every machine.
    """
    import pyarrow as pa

    known = docs.sparkSession.sparkContext.broadcast((proven(path), ranks(path)))  # an entry per vocabulary id at most
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(path, known.value, len, sum)
        for b in batches:
            n = pa.array(encode(b.column(2).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
