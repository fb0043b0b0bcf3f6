"""Token counts by the whole-token shortcut.

A vocabulary string counts as *proven* if the tokenizer, given that string alone,
answers with exactly one token; this is established once per vocabulary, before any
document is read. A text is cut at single spaces (no rule of the vocabulary crosses
one), each cut unit into the vocabulary's pre-tokens. A pre-token that is proven
adds one; only the others go through the library's merges. Units met before are
remembered up to a fixed number, so memory does not grow with the input.

Units with characters outside the range in which the pattern here and the
library's pattern are known to agree (tests compare every code point), and texts that
contain a special token's string, are counted by the library as a whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memory, slices, tidied

#: Units remembered by a worker; beyond it the memory starts anew.
REMEMBERED_UNITS = 600_000
#: Longer units are not remembered.
REMEMBERED_CHARS = 48

# Letters and digits of the range U+0000 to U+024F, U+0130 left out (its lower case has two code points).
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-įı-ɏ"
_DIGITS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_PRE_TOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
_AGREED = re.compile("[\t-\r\x20-\x7e\u0085 -įı-ɏ‐-‧‰-⁞]*")


@lru_cache(maxsize=4)
def _library(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    return tokenizer, re.compile("|".join(map(re.escape, specials)) or r"(?!)")


def prove_whole_tokens(path: str) -> frozenset[str]:
    """The lower-case strings of the vocabulary at ``path`` that encode, alone, as one token."""
    from tokenizers.decoders import ByteLevel

    tokenizer, special = _library(path)
    decoder = ByteLevel()
    ends = "</w>"
    texts = {decoder.decode([piece.removesuffix(ends)]) for piece in tokenizer.get_vocab() if piece.endswith(ends)}
    texts = sorted(t for t in texts if t and "�" not in t and _AGREED.fullmatch(t) and _PRE_TOKEN.fullmatch(t) and not special.search(t))
    found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    return frozenset(t for t, e in zip(texts, found, strict=True) if len(e.ids) == 1)


class Counter:
    """Counts tokens of texts as the library does."""

    def __init__(self, path: str, proven: frozenset[str]):
        self.tokenizer, self.special = _library(path)
        self.proven = proven
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True
        self.units: dict[str, int] = {}

    def _learn(self, units: set[str]) -> dict[str, int]:
        """Counts of units not met before; their hard pre-tokens go to the library together."""
        counts, hard, owners = {}, [], []
        for unit in units:
            if not _AGREED.fullmatch(unit):
                counts[unit] = len(self.tokenizer.encode(unit, add_special_tokens=False).ids)
                continue
            n = 0
            for piece in _PRE_TOKEN.findall(unit.lower()):
                if piece in self.proven:
                    n += 1
                else:
                    hard.append(piece)
                    owners.append(unit)
            counts[unit] = n
        for i in range(0, len(hard), 4096):  # one call for many pre-tokens; a token with the end mark ends each
            found = self.tokenizer.encode_batch_fast([" ".join(hard[i : i + 4096])], add_special_tokens=False)[0].ids
            last = np.flatnonzero(self.ends[np.array(found, np.int64)])
            for unit, n in zip(owners[i : i + 4096], np.diff(last, prepend=-1).tolist(), strict=True):
                counts[unit] += n
        return counts

    def count(self, texts: list[str]) -> list[int]:
        """Numbers of tokens, one for each text."""
        if len(self.units) > REMEMBERED_UNITS:
            self.units = {}
        known, out = self.units, []
        for text in texts:
            if self.special.search(text):
                out.append(len(self.tokenizer.encode(text, add_special_tokens=False).ids))
                continue
            n = 0
            for part in slices(text):
                units = part.split(" ")
                try:
                    n += sum(map(known.__getitem__, units))
                except KeyError:
                    new = self._learn(set(units).difference(known))
                    n += sum(new[u] if u in new else known[u] for u in units)
                    known.update((u, c) for u, c in new.items() if len(u) <= REMEMBERED_CHARS)
            out.append(n)
        return out


def _counter(path: str, proven: frozenset[str]) -> Counter:
    """The worker's counter; a worker keeps it from task to task of this kind."""
    kept = memory("token counters")
    if path not in kept:
        kept[path] = Counter(path, proven)
    return kept[path]


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """``id_col, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids come
    back as often as they came. Very long texts are cut at spaces while counting. Other columns are
    ignored, whatever their names. An empty table gives an empty result.
    """
    path = public_tokenizers.path(vocabulary)
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole_tokens(path))  # no larger than the vocabulary

    def each(batches):
        counter = _counter(path, proven.value)
        for batch in batches:
            n = counter.count([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(f"`{text_col}`"), F.lit(0)).cast("long").alias("n_bytes"), F.col(f"`{text_col}`").alias("_text"))
    return slim.mapInArrow(tidied(each, own="token counters"), f"_id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("_id", id_col)
