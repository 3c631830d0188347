"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For each prefix of a pretoken the DP holds the number of tokens and the last token: a
vocabulary token that ends there, whose pair with the last token before it encodes to just
these two. One token does so at each place; hence each prefix costs a few look-ups, and no
prefix is encoded by itself. Pretokens' counts add up to a text's; where a cut changes the
split (white space before a word, the first letters of a contraction), the pieces that the cut
text would have are counted.

The counts are kept as ``steps``: the change of the count at each character, one signed byte
each (four little-endian bytes each, if one of them doesn't fit). The running sum of steps is
the exact count at every prefix; budgets and truncations are answered from it.

Defined cases: a null text has null results; an empty one has 0 tokens and no steps; rows are
taken one by one, so ties and repeated rows each give theirs; a very long text is counted whole,
at every prefix; no rows in give no rows out; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathloom.llm import bpe

BUDGETS = (128, 1024)
ROWS = 256
#: Bytes of a piece's head; and bytes that a worker remembers of heads, pairs of tokens and units' steps, each by estimate.
HEAD, REMEMBERED = 6, 96 << 20
_W = r"\p{White_Space}"
_L, _S = bpe._L, bpe._S
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_SHORTENED = ("'re", "'ve", "'ll")


def _units(space: str, letters: str, digits: str, rest: str) -> str:
    """The pretokens' pattern, but a longer white space and the word after it are one unit."""
    short, word = "'s|'t|'re|'ve|'m|'ll|'d", f"{letters}+|{digits}+|{rest}+"
    return rf"{short}| ?{letters}+| ?{digits}+| ?{rest}+|{space}{{2,}}(?:(?<= )(?:{word})|(?<! )(?:{short}|{word}))?|{space}+"


_FULL = regex.compile(_units(_W, r"\p{L}", r"\p{N}", rf"[^{_W}\p{{L}}\p{{N}}]"))
_FAST = re.compile(_units(f"[{_S}]", f"[{_L}]", "[0-9]", f"[^{_S}{_L}0-9]"))


def units(text: str) -> list[str]:
    return (_FULL if bpe._PLAIN.search(text) else _FAST).findall(text)


class Prefixes:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest: dict[bytes, int] = {}  # of the tokens that end in these four bytes
        for t in ranks:
            if len(t) > 3:
                self.longest[t[-4:]] = max(len(t), self.longest.get(t[-4:], 0))
        self.heads = bpe.Remembered(lambda w: self._extend(w, [0], [0]), REMEMBERED)
        self.pairs = bpe.Remembered(self._pair, REMEMBERED)
        self.steps = bpe.Remembered(self._steps, REMEMBERED)

    def _pair(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return bpe.encode_word(self.tokens[a] + self.tokens[b], self.ranks) == [a, b]

    def _extend(self, word: bytes, count: list[int], last: list[int]) -> tuple[list[int], list[int]]:
        """Counts and last tokens at all prefixes of the word, from those at the first ones."""
        get, pairs, longest = self.ranks.get, self.pairs, self.longest
        for i in range(len(count), len(word) + 1):
            for a in range(max(0, i - longest.get(word[i - 4 : i], 3)) if i > 4 else 0, i):
                token = get(word[a:i])
                if token is not None and (a == 0 or pairs[last[a] << 32 | token]):
                    count.append(count[a] + 1)
                    last.append(token)
                    break
        return count, last

    def word(self, word: bytes) -> list[int]:
        """Counts at the prefixes of 0 to n bytes of one piece. Pieces that begin alike share the work on their heads."""
        count, last = self.heads[word[:HEAD]]
        return self._extend(word, count[:], last[:])[0] if len(word) > HEAD else count

    def chars(self, piece: str) -> list[int]:
        """Counts at the prefixes of 1 to n characters of one piece."""
        raw = piece.encode()
        count = self.word(raw)
        n = len(raw)
        return count[1:] if n == len(piece) else [count[k] for k in range(1, n + 1) if k == n or raw[k] & 0xC0 != 0x80]

    def unit(self, unit: str) -> list[int]:
        """Counts at the prefixes of 1 to n characters of one unit."""
        n = len(unit) - len(unit.lstrip(_SPACE))
        if 1 < n < len(unit):
            space = self.chars(unit[:n])
            if unit[n - 1] == " ":
                return space + [space[n - 2] + c for c in self.chars(unit[n - 1 :])[1:]]
            base = space[n - 2] + self.chars(unit[n - 1])[-1]
            return space + [base + c for c in self.unit(unit[n:])]
        if unit in _SHORTENED:  # a cut one is an apostrophe and a letter
            return [1, 2, self.chars(unit)[-1]]
        return self.chars(unit)

    def _steps(self, unit: str) -> bytes | list[int]:
        """One signed byte a step, or the steps themselves where one doesn't fit."""
        count = self.unit(unit)
        steps = [b - a for a, b in zip([0, *count], count)]
        return bytes([s & 255 for s in steps]) if -129 < min(steps) and max(steps) < 128 else steps


class Counter:
    def __init__(self, raw: bytes):
        self.prefixes = Prefixes(bpe.read_ranks(raw))

    def steps(self, text: str) -> np.ndarray:
        """The change of the count at each character."""
        parts = list(map(self.prefixes.steps.__getitem__, units(text)))
        if any(type(p) is list for p in parts):
            return np.concatenate([np.array(p, "<i4") if type(p) is list else np.frombuffer(p, np.int8).astype("<i4") for p in parts])
        return np.frombuffer(b"".join(parts), np.int8)


_counters: dict[int, Counter] = {}


def counter(raw: bytes) -> Counter:
    if (k := hash(raw)) not in _counters:
        _counters[k] = Counter(raw)
    return _counters[k]


def counts(steps: bytes, step_bytes: int = 1) -> np.ndarray:
    """The count at every prefix of 1 to n characters, from stored steps."""
    return np.cumsum(np.frombuffer(steps, np.int8 if step_bytes == 1 else "<i4"), dtype=np.int32)


def fitting(count: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most so many tokens."""
    ok = count[::-1] <= budget
    return len(count) - int(ok.argmax()) if len(count) and ok.any() else 0


def prefix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = bpe.VOCABULARY, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """doc_id, n_chars, n_tokens, step_bytes (1 or 4), steps, and fits_<budget>: the characters of the longest prefix within each budget."""
    shared = bpe.shared_vocabulary(docs, vocabulary)
    names = [f"fits_{b}" for b in budgets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(shared.value)
        for whole in batches:
            for b in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS)):
                rows = []
                for t in b.column(1).to_pylist():
                    if t is None:
                        rows.append((None,) * (4 + len(budgets)))
                        continue
                    s = own.steps(t)
                    c = np.cumsum(s, dtype=np.int32)
                    n = int(c[-1]) if len(c) else 0
                    rows.append((len(t), n, s.itemsize if len(s) else 1, s.tobytes(), *(len(t) if n <= x else fitting(c, x) for x in budgets)))
                cols = list(zip(*rows))
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), *[pa.int32()] * len(budgets)]
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n_chars", "n_tokens", "step_bytes", "steps", *names])

    schema = "doc_id bigint, n_chars int, n_tokens int, step_bytes int, steps binary" + "".join(f", {n} int" for n in names)
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
