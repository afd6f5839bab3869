"""Token counts by a shortcut: words that are proven to be one token are counted, only the others are merged.

``prove`` runs once, on the driver, over the vocabulary: a string is whole if the library's own merges, given it alone, end
with that one token. It also asks the library, for each common character, which kind the splitter takes it for and whether
normalising it means lower case and nothing else. Both proofs leave as bitmaps and ranges of some kilobytes.

In a task, a text of such steady characters is lowered and split by one regular expression; its words are looked up in a
table of whole strings and of words merged before (bounded, dropped when full), and a word that is new is merged by the
library. Any other text goes through the library's normaliser and splitter first. Special strings in texts are one token
each, as is the library's default; they are cut out before anything else.

Long texts are taken in blocks that begin with white space: words, special strings and normal forms never span ASCII
white space. Defined results: a null text is empty and has no token; rows that repeat are counted each time; null ids
stay; an empty table gives an empty table; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from undula.llm._arrow import kept, offsets, slices

#: Characters of a text that are split at a time.
BLOCK = 1 << 20
#: Words that a worker remembers with their counts, each of ``WORD`` characters at most.
MEMORY, WORD = 400_000, 64
#: Code points that are asked about; texts with others go through the library.
ASKED = (*range(0xD800), *range(0xE000, 0x10000), *range(0x1F000, 0x1FC00))
_WHITE = re.compile(r"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Proof:
    whole: bytes  # a bit for each id of the vocabulary
    letters: str  # steady characters by kind, as ranges of a regular expression
    digits: str
    spaces: str
    others: str


def _ranges(points: Iterable[int]) -> str:
    out: list[list[int]] = []
    for p in sorted(points):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _composing() -> set[int]:
    """Code points that normalising may join with the one before."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x30000))
    return {int(p[1], 16) for p in pairs if len(p) == 2 and p[0][0] != "<"} | set(range(0x1100, 0x1200))


def _kinds(splitter, points: Iterable[int]) -> dict[int, str]:
    """letter, digit, space or other, by what the library's splitter makes of each character between known ones."""
    points = list(points)
    out: dict[int, str] = {}
    for k in range(0, len(points), 4096):
        some = points[k : k + 4096]
        pieces = {span for _, span in splitter.pre_tokenize_str("".join(f" a{chr(c)} !{chr(c)} {chr(c)}" for c in some))}
        for n, c in enumerate(some):
            at = 8 * n
            out[c] = "letter" if (at + 1, at + 3) in pieces else "other" if (at + 4, at + 6) in pieces else "digit" if (at + 7, at + 8) in pieces else "space"
    return out


def _load(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    if any(a.lstrip or a.rstrip or a.single_word or a.normalized for a in t.get_added_tokens_decoder().values()):
        raise ValueError("added tokens that look at their surroundings are not supported")
    return t


def prove(path: str) -> Proof:
    """For a vocabulary of words with ends whose texts are lowered and split into letters, single digits and others."""
    t = _load(path)
    suffix = t.model.end_of_word_suffix or ""
    vocabulary = t.get_vocab(with_added_tokens=False)
    bits = np.zeros(max(vocabulary.values()) + 1, bool)
    for word, at in vocabulary.items():
        if word.endswith(suffix) and len(word) > len(suffix):
            made = t.model.tokenize(word[: len(word) - len(suffix)])
            bits[at] = len(made) == 1 and made[0].id == at
    kinds, composing = _kinds(t.pre_tokenizer, ASKED), _composing()
    steady: dict[str, list[int]] = {"letter": [], "digit": [], "space": [], "other": []}
    for c in ASKED:
        ch = chr(c)
        if unicodedata.category(ch) == "Cn" or unicodedata.combining(ch) or c in composing:
            continue
        if kinds[c] == "space":
            fine = t.normalizer.normalize_str(ch) == " "
        else:
            low = _lower(ch)
            fine = t.normalizer.normalize_str(ch) == low
        if fine:
            steady[kinds[c]].append(c)
    known = {chr(c) for own in steady.values() for c in own}
    for kind, own in steady.items():
        steady[kind] = [c for c in own if known.issuperset(_lower(chr(c)))]
    return Proof(np.packbits(bits).tobytes(), *(_ranges(steady[k]) for k in ("letter", "digit", "space", "other")))


def _lower(text: str) -> str:
    return text.replace("Σ", "σ").lower()  # a final sigma is a sigma, as for the library


class Known(dict):
    """Counts of words; a new word is merged, and remembered while there is room."""

    def __init__(self, whole: Iterable[str], merge):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.merge, self.merged = len(self), merge, 0

    def __missing__(self, word: str) -> int:
        self.merged += 1
        n = self.merge(word)
        if len(word) <= WORD:
            if len(self) >= self.whole + MEMORY:
                for w in [*self][self.whole :]:
                    del self[w]
            self[word] = n
        return n


class Counter:
    """Counts tokens of texts as the library would."""

    def __init__(self, path: str, proof: Proof):
        from tokenizers import pre_tokenizers

        self.library = t = _load(path)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        suffix = len(t.model.end_of_word_suffix or "")
        bits = np.unpackbits(np.frombuffer(proof.whole, np.uint8))
        spelled = [w[: len(w) - suffix] for w, k in t.get_vocab(with_added_tokens=False).items() if bits[k]]
        every = "".join(map(chr, (*range(0x800), *range(0x800, 0xD800, 0x400), *range(0xE000, 0x110000, 0x1000))))  # holds each byte of UTF-8
        byte = dict(zip("".join(p for p, _ in level.pre_tokenize_str(every)), every.encode()))
        plain = [b.decode() for b in (bytes(byte[x] for x in w) for w in spelled if all(x in byte for x in w)) if b.decode(errors="replace").encode() == b]
        spell = lambda w: w if w.isascii() and w.isalpha() else level.pre_tokenize_str(w)[0][0]
        self.known = Known(plain, lambda w: len(t.model.tokenize(spell(w))))
        self.spelled = Known(spelled, lambda w: len(t.model.tokenize(w)))
        letters, digits, others = proof.letters, proof.digits, proof.others
        self.split = re.compile(f"[{letters}]+|'s|'t|'re|'ve|'m|'ll|'d|[{digits}]|[{others}]+").findall
        self.steady = frozenset(re.findall(f"[{letters}{digits}{others}{proof.spaces}]", "".join(map(chr, ASKED))))
        added = sorted((a.content for a in t.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else re.compile(r"(?!)")

    def words(self, text: str) -> int:
        if text.isascii() or self.steady.issuperset(text):
            return sum(map(self.known.__getitem__, self.split(_lower(text))))
        t = self.library
        return sum(self.spelled[w] for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(text)))

    def count(self, text: str) -> int:
        total = 0
        for block in blocks(text):
            parts = self.special.split(block)
            total += len(parts) - 1 + sum(self.words(p) for p in parts if p)
        return total


def blocks(text: str, size: int | None = None) -> Iterator[str]:
    """The text in parts of about ``size`` characters, all but the first beginning with white space."""
    size = BLOCK if size is None else size
    at = 0
    while at < len(text):
        m = _WHITE.search(text, at + size) if len(text) > at + size else None
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def counts(df: DataFrame, key: str, text: str, path: str, limit: int = 2048, proof: Proof | None = None) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row, by the vocabulary at ``path``, which workers read too."""
    proof = prove(path) if proof is None else proof
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]):
        counter = kept("tokencount", (path, proof), lambda: Counter(path, proof))
        for part in slices(batches, 1, operator="tokencount"):
            column = part.column(1).fill_null("") if part.column(1).null_count else part.column(1)
            n = np.array([counter.count(t) for t in column.to_pylist()], np.int64)
            yield pa.record_batch([part.column(0).cast(to_arrow_type(kind)), pa.array(np.diff(offsets(column))), pa.array(n), pa.array(n > limit)], ["key", "n_bytes", "n_tokens", "over_limit"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
