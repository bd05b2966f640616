"""Exact token counts at every prefix of a text, by prefix dynamic programming over a fixed BPE vocabulary.

The tokenizer cuts a text into words and encodes each word alone, so the count of a prefix that ends with a word is the
count of the prefix before that word plus the word's own count: one pass fills the table, and a word is encoded once per
worker however often it comes. Inside a word the table goes on symbol by symbol: the encoding of a prefix ends with the
one token t for which the encoding of the prefix without t ends with a token that BPE leaves apart from t
(word_prefix_counts). Truncation and budget questions are then look-ups; no text is encoded twice.

Defined results: a null or empty text has no tokens; special strings inside a text are one token each, as is the
library's default; repeated rows each give a row; texts are counted whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_text, plain

#: Words kept with their counts by one worker, at most; the store starts anew beyond that.
STORE = 1_500_000
#: New words encoded in one call, apart by spaces, told apart by the mark of a word's last token.
JOINED = 500
#: Texts of these characters alone are cut here; all Unicode versions class, lower-case and compose them alike. Texts with others go through the library's own stages.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u017f\u2010-\u2027\u20ac]*")
_LETTER, _NUMBER = r"a-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: The words of the vocabulary's own pattern (fixed values), with the letters and numbers that PLAIN has after lower-casing.
WORD = re.compile(rf"[{_LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")


#: The normalizers and the words' pattern of the vocabulary that PLAIN and WORD speak for.
SHORT_WAY = ({"NFC", "Replace", "Lowercase"}, r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _parts(stage: dict | None, key: str) -> list[dict]:
    return [] if stage is None else stage[key] if stage["type"] == "Sequence" else [stage]


class PrefixCounter:
    """Counts for one tokenizer file of the library `tokenizers`: BPE over bytes that encodes words alone. Others are refused by name."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.path, self.tokenizer, self.store = path, Tokenizer.from_file(path), {}
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cuts, model = _parts(spec["pre_tokenizer"], "pretokenizers"), spec["model"]
        if model.get("type", "BPE") != "BPE" or model.get("byte_fallback") or model.get("dropout") or not any(c["type"] == "ByteLevel" and not c["add_prefix_space"] for c in cuts):
            raise ValueError(f"{path} is no byte-level BPE whose words are encoded alone")
        patterns = [c["pattern"].get("Regex") for c in cuts if c["type"] == "Split"]
        self.short = ({n["type"] for n in _parts(spec["normalizer"], "normalizers")}, *patterns) == SHORT_WAY
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, self.specials))) if self.specials else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.vocab, self.suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.longest = max(map(len, self.vocab))
        self.ends = np.zeros(max(self.vocab.values(), default=0) + 1 + len(self.specials), bool)
        self.ends[[i for t, i in self.vocab.items() if self.suffix and t.endswith(self.suffix)]] = True
        self.apart = lru_cache(1 << 20)(self._apart)

    def words(self, text: str) -> list[str]:
        """The words of a text without special strings, as the library would encode each."""
        if self.short and PLAIN.fullmatch(text):
            return WORD.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())
        t = self.tokenizer
        return [text_of(w) for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text) if t.normalizer else text)]

    def _learn(self, words: set[str]) -> None:
        new = list(words - self.store.keys())
        if len(self.store) + len(new) > STORE:
            self.store.clear()
            new = list(words)
        groups = [new[lo : lo + JOINED] for lo in range(0, len(new), JOINED)] if self.suffix else [[w] for w in new]
        for lo in range(0, len(groups), 64):
            part = groups[lo : lo + 64]
            for own, e in zip(part, self.tokenizer.encode_batch_fast([" ".join(g) for g in part], add_special_tokens=False), strict=True):
                counts = np.diff(np.flatnonzero(self.ends[e.ids]), prepend=-1).tolist() if self.suffix else [len(e)]
                if len(counts) != len(own):  # a word that doesn't stand alone between spaces
                    counts = [len(x) for x in self.tokenizer.encode_batch_fast(own, add_special_tokens=False)]
                self.store.update(zip(own, counts, strict=True))

    def pieces(self, text: str) -> list[list[str]]:
        """Words of the stretches between special strings."""
        if self.special is None or not any(s in text for s in self.specials):
            return [self.words(text)]
        return [self.words(x) for x in self.special.split(text)]

    def prefix_counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the token counts of its prefixes that end with a word or special string, from the empty prefix on."""
        cut = [self.pieces(t) for t in texts]
        self._learn({w for stretches in cut for words in stretches for w in words})
        get = self.store.__getitem__
        out = []
        for stretches in cut:
            each: list[int] = []
            for k, words in enumerate(stretches):
                if k:
                    each.append(1)
                each.extend(map(get, words))
            table = np.zeros(len(each) + 1, np.int64)
            np.cumsum(np.fromiter(each, np.int64, len(each)), out=table[1:])
            out.append(table)
        return out

    def _bpe(self, symbols: tuple[str, ...]) -> tuple[str, ...]:
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(parts)

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.suffix and token.endswith(self.suffix):
            body = token[: -len(self.suffix)]
            return (*body[:-1], body[-1] + self.suffix)
        return tuple(token)

    def _apart(self, a: str, b: str) -> bool:
        """Whether BPE over the symbols of a and b gives a and b; with a empty, whether it gives b."""
        return self._bpe((*self._symbols(a), *self._symbols(b))) == ((a, b) if a else (b,))

    def word_prefix_counts(self, word: str) -> list[int]:
        """Token counts of all prefixes of a word (as self.words gives it), by characters from 0 to all."""
        byte = byte_letters()
        marked = "".join(byte[x] for x in word.encode())
        last, n_open, n_ended = [""], [0], [0]
        for i in range(1, len(marked) + 1):
            for suffix in dict.fromkeys(("", self.suffix)):
                found = None
                for j in range(max(0, i - self.longest), i):
                    t = marked[j:i] + suffix
                    if last[j] is not None and t in self.vocab and self.apart(last[j], t):
                        found = (t, n_open[j] + 1)
                        break
                if suffix:
                    n_ended.append(found[1])
                else:
                    last.append(found[0] if found else None)
                    n_open.append(found[1] if found else 1 << 30)
        counts = n_ended if self.suffix else n_open
        ends = [0, *accumulate(len(c.encode()) for c in word)]
        out = [counts[e] for e in ends]
        if word in ("'re", "'ve", "'ll"):  # without its last letter it's a quote and a letter apart
            out[2] = out[1] + self.word_prefix_counts(word[1])[1]
        return out

    def cut(self, text: str, budget: int) -> tuple[int, int]:
        """(words and special strings, characters of the next word) of the longest prefix of at most budget tokens."""
        table = self.prefix_counts([text])[0]
        k = bisect_right(table.tolist(), budget) - 1
        return k, self.inside(text, k, budget - int(table[k]))

    def inside(self, text: str, k: int, room: int) -> int:
        """The most characters of the text's word number k, from 0, that take at most room tokens."""
        flat = [w for i, ws in enumerate(self.pieces(text)) for w in ([None] * bool(i) + ws)]
        if k == len(flat) or flat[k] is None:
            return 0
        counts = self.word_prefix_counts(flat[k][: room * self.longest + 4])  # more characters take more tokens than room
        return max(c for c, n in enumerate(counts) if n <= room)


@lru_cache(1)
def byte_letters() -> list[str]:
    """The visible letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


@lru_cache(1)
def _bytes_of() -> dict[str, int]:
    return {c: b for b, c in enumerate(byte_letters())}


def text_of(marked: str) -> str:
    back = _bytes_of()
    return bytes(back[c] for c in marked).decode()


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter a worker process, so that its store serves all its tasks."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


FOUND = T.StructType([T.StructField(n, T.LongType()) for n in ("n_bytes", "n_tokens", "fit_words", "fit_tokens", "fit_chars")])


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """row (struct of the columns keep) and found: n_bytes, n_tokens, and of the longest prefix within limit that ends with a word its words and tokens, and the characters of the next word that fit besides. tokenizer: a name for public_tokenizers.path, or a path."""

    docs = plain(docs)

    def kernel(texts: pa.Array, _):
        import public_tokenizers

        c = counter(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        strings = texts.to_pylist()
        tables = c.prefix_counts(strings)
        fit = [int(np.searchsorted(t, limit, side="right")) - 1 for t in tables]
        cols = {"n_bytes": [len(s.encode()) for s in strings], "n_tokens": [int(t[-1]) for t in tables], "fit_words": fit, "fit_tokens": [int(t[k]) for t, k in zip(tables, fit, strict=True)]}
        cols["fit_chars"] = [c.inside(x, k, limit - int(t[k])) if k < len(t) - 1 else 0 for x, t, k in zip(strings, tables, fit, strict=True)]
        return {k: pa.array(v, pa.int64()) for k, v in cols.items()}

    return map_text(docs, text, keep or docs.columns, kernel, FOUND)
