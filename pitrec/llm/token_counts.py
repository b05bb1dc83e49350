"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

For BPE the encoding of a prefix has one fixed last token, and that token t is
the only one ending there for which re-encoding (last token of the rest, t)
gives the two back unchanged. So one pass over a pre-token fills a table
count[i] = count[i - len(t)] + 1 with the exact token count of each of its
prefixes. A text's table joins those of its pre-tokens; where the text, cut
there, would fall into other pre-tokens (white space, contractions, special
tokens), that tail alone is counted anew. `prefix_tables` stores the count at
every character, so that totals, truncation points and budget questions are
lookups without encoding again; `token_counts` takes the totals from the same
tables. Those of pre-tokens are kept in a bounded memo, since words repeat.

Special tokens in a text count as the library's default has them: one token
each. Null counts as empty: 0 tokens. Rows repeat as given, null ids too; extra
columns are ignored; an empty table gives no rows. Very long texts and
pre-tokens count whole, in windows that end where all paths meet.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, slices, table
from .prefix_bpe import START, Memo, PrefixRule

MEMO = 250_000  # words in a generation of a worker's memo
SHORT = 48  # characters of words that the memo keeps
STEP = 4096  # bytes of a word between two looks for a meeting of all paths

# The byte-level alphabet (printable bytes stand for themselves, the rest follow from code point 256)
# and the pre-token pattern of this vocabulary family, with its contractions of three characters.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def _byte_alphabet() -> dict[str, int]:
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix tables for the vocabulary in a tokenizers .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        special = [x["content"] for x in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.blank = regex.compile(r"\s+")
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        rank: dict[bytes, int] = {}
        for k, (a, b) in enumerate(merges):
            rank.setdefault(bytes(alphabet[c] for c in a + b), k)
        self.rule = PrefixRule(rank)
        self._memo = Memo(self._word_count, MEMO, SHORT)

    def byte_table(self, raw: bytes) -> list[int]:
        """The exact token count of each prefix of a word, for 0 to all of its bytes."""
        base, last, back, count, out, stop = 0, [START], [0], [0], [], 0
        while stop < len(raw):
            known = len(last)
            stop = min(len(raw), stop + STEP)
            self.rule.scan(raw, base, last, back, stop)
            for k in back[known:]:
                count.append(count[k - base] + 1)
            meet = self.rule.meeting(back, base, stop) if stop < len(raw) else stop
            out += count[: meet - base]
            last, back, count, base = last[meet - base :], back[meet - base :], count[meet - base :], meet
        return out + count

    def word_table(self, word: str) -> list[int]:
        """The exact token count of each prefix of a word, for 0 to all of its characters."""
        raw = word.encode("utf-8", "surrogatepass")
        counts = self.byte_table(raw)
        if len(raw) == len(word):
            return counts
        return [counts[0], *(counts[k] for k in range(1, len(raw) + 1) if k == len(raw) or raw[k] & 0xC0 != 0x80)]

    def _word_count(self, word: str) -> int:
        return self.byte_table(word.encode("utf-8", "surrogatepass"))[-1]

    def word_count(self, word: str) -> int:
        return self._memo[word]

    def chunks(self, text: str):
        """Spans without special tokens, and each special token between them; (span, whether it is special)."""
        at = 0
        for m in self.special.finditer(text) if self.special is not None else ():
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def table(self, text: str) -> tuple[list[str], np.ndarray]:
        """Pre-tokens, and the exact tokens up to the end of each."""
        words, counts = [], []
        for chunk, special in self.chunks(text):
            if special:
                words.append(chunk)
                counts.append(1)
            elif chunk:
                found = self.pattern.findall(chunk)
                words += found
                counts += map(self._memo.__getitem__, found)
        return words, np.cumsum(counts, dtype=np.int64)

    def count(self, text: str | None) -> int:
        tokens = self.table(text or "")[1]
        return int(tokens[-1]) if len(tokens) else 0

    def prefix_counts(self, text: str) -> array:
        """The exact token count of text[:i] as a text of its own, for every i in characters."""
        out, done = array("i", [0]), 0
        words, before = [], []  # of the span, and the tokens before each
        for chunk, special in self.chunks(text):
            if special:
                k = max(0, len(words) - 3)
                tail, first = "".join(words[k:]), before[k] if words else done
                out.extend(first + self.count(tail + chunk[:i]) for i in range(1, len(chunk)))  # cut inside: ordinary text, which joins what is before
                done += 1
                out.append(done)
                continue
            words, before, run, at_run = self.pattern.findall(chunk), [], "", done
            for w in words:
                before.append(done)
                counts = self.word_table(w)
                blank = self.blank.fullmatch(w) is not None
                first = len(out)
                out.extend([done + n for n in counts[1:]])
                if run and (blank or w[0] == " "):  # a text that ends in white space has all of it as one pre-token
                    for i in range(1, len(w) + 1 if blank else 2):
                        out[first + i - 1] = at_run + self.word_count(run + w[:i])
                if w in LONG_CONTRACTIONS:
                    out[first + 1] = done + self.word_count(w[0]) + self.word_count(w[1])
                if blank:
                    run, at_run = run + w, at_run if run else done
                else:
                    run = ""
                done += counts[-1]
        return out

    def cut(self, text: str, budget: int) -> int:
        """The characters of the longest prefix that has no more tokens than the budget."""
        return int(np.flatnonzero(np.asarray(self.prefix_counts(text)) <= budget)[-1]) if budget >= 0 else 0


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit, n_words_within): n_words_within whole pre-tokens from the start fit the limit."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counter = kept_in_worker(("prefix counter", path), lambda: PrefixCounter(path))
        for batch in (few for batch in batches for few in slices(batch, 1)):
            size, total, within = [], [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                tokens = counter.table(text)[1]
                size.append(len(text.encode("utf-8", "surrogatepass")))
                total.append(int(tokens[-1]) if len(tokens) else 0)
                within.append(int(np.searchsorted(tokens, limit, side="right")))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total]), pa.array(within, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "n_words_within"],
            )

    kind = dict(src.dtypes)["id"]
    return src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_words_within bigint")


def prefix_tables(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts): the exact tokens of the text's first 0, 1, 2, ... characters; `count_at` and `chars_within` read it."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        counter = kept_in_worker(("prefix counter", path), lambda: PrefixCounter(path))
        for batch in batches:
            for few in slices(batch, 1):
                held = [np.asarray(counter.prefix_counts(t or ""), dtype=np.int32) for t in few.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, held)], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([few.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))], names=["id", "counts"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, counts array<int>")


def count_at(tables: DataFrame, n_chars: int) -> DataFrame:
    """(id, n_tokens): the tokens of the first n_chars characters, or of the whole text if it is shorter."""
    return tables.select("id", F.element_at("counts", F.least(F.lit(n_chars + 1), F.size("counts"))).alias("n_tokens"))


def chars_within(tables: DataFrame, budget: int) -> DataFrame:
    """(id, n_chars, n_tokens): the longest prefix of no more tokens than the budget (0 or more)."""
    n = F.expr(f"array_max(filter(sequence(0, size(counts) - 1), i -> get(counts, i) <= {int(budget)}))")
    return tables.withColumn("n_chars", n).select("id", "n_chars", F.expr("get(counts, n_chars)").alias("n_tokens"))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")
