"""Chat formatting with loss masks aligned by offsets.

A whole conversation becomes one string, encoded once; for a byte-level vocabulary given as ranks the tokens' lengths give their
offsets, for others the library does. Turns are marked by control strings that the tokenizer takes as
single tokens; inside texts and roles, every `<`, backslashes, `|` gets one backslash more, so no text contains a control
string and taking one backslash away gives the text back. The sorted spans of the turns' texts and the sorted offsets of
the tokens are intersected by binary search: a token is under the loss where it lies in an assistant's text.

Defined results: a null text or role is empty; equal turn numbers go by role, then text; null turn numbers come first; an
empty assistant text has no tokens and no loss; repeated rows are repeated turns; a null conversation is one of its own;
columns besides the four named aren't read. A conversation is one row, as long as it may be.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .common import plain, small_batches

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURNS = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The conversation's string, and starts and ends of its texts in it."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        starts.append(at + len(head))
        ends.append(starts[-1] + len(body))
        at = ends[-1] + len(END)
        parts += [head, body, END]
    return "".join(parts), np.array(starts, np.int64), np.array(ends, np.int64)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The inverse of render."""
    return [(unescape(r), unescape(t)) for r, t in _TURNS.findall(formatted)]


def loss_mask(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens meet one of the sorted spans."""
    if not len(starts):
        return np.zeros(len(token_starts), bool)
    k = np.searchsorted(starts, token_ends, side="left") - 1  # the last span that starts before the token ends
    return (k >= 0) & (token_starts < ends[np.maximum(k, 0)])


def char_spans(formatted: str, byte_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends in characters of tokens that end at these bytes, one after another; a character that tokens share belongs to each."""
    byte_ends = byte_ends.astype(np.int64)
    if not len(byte_ends):
        return byte_ends, byte_ends
    starts = np.concatenate([[0], byte_ends[:-1]])
    if formatted.isascii():
        return starts, byte_ends
    data = np.frombuffer(formatted.encode(), np.uint8)
    begun = np.cumsum((data & 0xC0) != 0x80)  # characters that have begun with this byte
    return begun[starts] - 1, begun[byte_ends - 1]


class _Ranked:
    """A byte-level vocabulary given as ranks: tokens are bytes of the text, so their lengths give the offsets."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        first = max(ranks.values()) + 2  # one id is free for the file's own end of text
        own = {s: first + k for k, s in enumerate((TURN, TEXT, END))}
        self.encoding = tiktoken.Encoding("chat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)
        self.control = frozenset(own)
        self.lengths = np.zeros(first + len(own), np.int64)
        for token, rank in ranks.items():
            self.lengths[rank] = len(token)
        for token, rank in own.items():
            self.lengths[rank] = len(token)

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = self.encoding.encode_to_numpy(formatted, allowed_special=self.control, disallowed_special=()).astype(np.int32)
        return ids, *char_spans(formatted, np.cumsum(self.lengths[ids]))


class _Library:
    """A file of the library `tokenizers`, which gives offsets itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding(), self.tokenizer.no_truncation()
        self.tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
        self.tokenizer.add_special_tokens([TURN, TEXT, END])

    def encode(self, formatted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = self.tokenizer.encode(formatted, add_special_tokens=False)
        spans = np.array(e.offsets, np.int64).reshape(-1, 2)
        return np.array(e.ids, np.int32), spans[:, 0], spans[:, 1]


_tokenizers: dict[str, _Ranked | _Library] = {}


def tokenizer_of(name: str) -> _Ranked | _Library:
    """name: for public_tokenizers.path, or a path; of byte-level vocabularies, so that all text is in tokens."""
    if name not in _tokenizers:
        import public_tokenizers

        path = name if os.path.isabs(name) else public_tokenizers.path(name)
        _tokenizers[name] = (_Ranked if path.endswith(".tiktoken") else _Library)(path)
    return _tokenizers[name]


SCHEMA = "conv_id {id}, n_turns long, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def chat_format(rows: DataFrame, tokenizer: str = "byte_bpe_50k.tiktoken", conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: its string, its tokens with their offsets, and the mask of the tokens under the loss."""
    rows = plain(rows)
    small_batches(rows.sparkSession)
    c = lambda n: rows[f"`{n}`"]
    turns = rows.select(c(conv).alias("conv_id"), F.struct(c(turn).alias("turn"), F.coalesce(c(role).cast("string"), F.lit("")).alias("role"), F.coalesce(c(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")).select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        encoder = tokenizer_of(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                n_turns, strings, ids, first, last, loss = [], [], [], [], [], []
                for roles, texts in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    formatted, starts, ends = render(list(zip(roles, texts, strict=True)))
                    own = np.array([r == "assistant" for r in roles], bool)
                    tokens, token_starts, token_ends = encoder.encode(formatted)
                    n_turns.append(len(roles)), strings.append(formatted), ids.append(tokens), first.append(token_starts), last.append(token_ends)
                    loss.append(loss_mask(token_starts, token_ends, starts[own], ends[own]))
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
                lists = [K.lists(np.concatenate(x).astype(kind), at, arrow) for x, kind, arrow in ((ids, np.int32, pa.int32()), (first, np.int32, pa.int32()), (last, np.int32, pa.int32()), (loss, bool, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_turns, pa.int64()), pa.array(strings, pa.string()), *lists], names=["conv_id", "n_turns", "formatted", "token_ids", "starts", "ends", "loss"])

    return whole.mapInArrow(run, SCHEMA.format(id=rows.schema[conv].dataType.simpleString()))


def loss_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts that runs of tokens under the loss cover, unescaped."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], loss, [False]]).astype(np.int8)))
    return [unescape(formatted[starts[a] : ends[b - 1]]) for a, b in edge.reshape(-1, 2).tolist()]


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what chat_format has written, from its strings, offsets and masks alone."""

    def run(batches):
        for batch in batches:
            rows = []
            lists = [batch.column(k) for k in (2, 3, 4)]
            starts, ends, loss = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            at = np.concatenate([[0], np.cumsum(pc.list_value_length(lists[0]).to_numpy())]).astype(np.int64)
            for k, (conv_id, formatted) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = slice(at[k], at[k + 1])
                turns = parse(formatted)
                said = "".join(loss_texts(formatted, starts[own], ends[own], loss[own]))
                whole = "".join(f"{a}\n{b}\n" for a, b in turns)
                rows.append({"conv_id": conv_id, "n_turns": len(turns), "turns_sha256": hashlib.sha256(whole.encode()).hexdigest(), "loss_chars": len(said), "loss_sha256": hashlib.sha256(said.encode()).hexdigest(), "formatted_chars": len(formatted)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", batch.schema.field("conv_id").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.select("conv_id", "formatted", "starts", "ends", "loss").mapInArrow(run, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
