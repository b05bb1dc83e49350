"""SentencePiece encoding and decoding by a streaming Viterbi pass.

The BPE model files allow one last piece for each prefix: the piece p ending
there for which (last piece before p, p) encodes to itself. That gives the
Viterbi pass one back pointer a position. A piece to come can only start at one
of the last `longest` positions, so the surviving paths are the chains from
these; once all run through one boundary, the ids up to it are committed and
forgotten, and the window begins there. All texts go this way, block by block,
and memory does not grow with a text but by its ids.

The forward pass goes stretch by stretch: between two characters that no piece
holds side by side the scan starts anew, so its back pointers inside a stretch do
not depend on what is before; an automaton names the pieces that end at each of its
places. A bounded memo has those of the stretches seen
lately, with the ids of their own path, which saves their scan and nothing else: ids
are committed by meetings of paths alone, looked for every LOOK stretches, and every
`step` characters inside long ones.

Unknown characters become byte pieces. Null and empty texts encode to no ids and
decode to "". Rows repeat as given; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, slices, table
from .prefix_bpe import START, Memo, PrefixRule

MEMO = 250_000  # stretches in a generation of a worker's memo
LOOK = 16  # stretches between two looks for a meeting
SHORT = 48  # characters of stretches that the memo keeps
BLOCK = 1 << 16  # characters of a text taken at a time
SPACE = "▁"  # fixed value: the mark that stands for a space


class Codes(dict):
    """The ids of a numbered piece as bytes, by number."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, number: int) -> bytes:
        self[number] = value = self.make(number)
        return value


class Scan:
    """The forward pass over a stretch that comes in parts; it holds the last `longest` positions."""

    def __init__(self, rule: PrefixRule):
        self.rule, self.tail, self.last, self.back = rule, "", [START], [0]
        self.at = 0  # characters before the tail
        self.open = False  # True if the last entry of a window is this stretch's

    def __call__(self, more: str) -> tuple[array, array]:
        """(last piece, its start from the begin of the stretch) of each prefix that ends in `more`."""
        text, known = self.tail + more, len(self.last)
        self.rule.scan(text, 0, self.last, self.back, len(text))
        out = array("i", self.last[known:]), array("i", [self.at + k for k in self.back[known:]])
        drop = max(0, len(text) - self.rule.longest)  # no piece to come starts before
        self.tail, self.last, self.back = text[drop:], self.last[drop:], [k - drop for k in self.back[drop:]]
        self.at += drop
        return out


class Window:
    """What is scanned and not committed: entries (ids, last pieces, where they start) of stretches, in order.

    An entry's back pointers lead to its begin; of the first one, `given` bytes of ids are committed already.
    """

    def __init__(self, longest: int, ids):
        self.longest, self.ids, self.n_commits = longest, ids, 0
        self.entries: list[tuple[bytes, Sequence[int], Sequence[int]]] = []
        self.given = 0

    def commit(self) -> bytes:
        """The ids up to the last boundary that all surviving paths share; they are forgotten here.

        Pieces to come start at one of the last `longest` positions, so the surviving paths are those back from these.
        """
        entries, longest = self.entries, self.longest
        first, n = len(entries), 0
        while first and n < longest:
            first -= 1
            n += len(entries[first][2])
        low, meet, given = n - longest + 1, 0, self.given
        if low > 0:  # paths end to end run through the end of this entry, those of its own last positions join them
            whole, last, back = entries[first]
            meet = at = len(back)
            there = {0}
            while at:
                there.add(at)
                at = back[at - 1]
            for other in range(low, len(back)):
                while other not in there:
                    other = back[other - 1]
                if other < meet:
                    meet = other
        out = b"".join([e[0] for e in entries[:first]])
        if first:
            out, given = out[given:], 0
        if meet == 0:
            del entries[:first]
        elif meet == len(back):
            out += whole[given:]
            del entries[: first + 1]
            given = 0
        else:  # inside the entry, of which the rest stays
            part = self.ids(last, back, meet)
            out += part[given:]
            del entries[:first]
            given = max(given, len(part))
        self.given = given
        self.n_commits += bool(out)
        return out

    def rest(self) -> bytes:
        """All of it, at the end of the text."""
        return b"".join([e[0] for e in self.entries])[self.given :]


class Pieces:
    """A SentencePiece BPE model with identity normalisation, a dummy leading space and byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.id, self.byte = [], {}, [0] * 256
        score = {}
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(k) or sp.is_unknown(k):
                self.text.append(b"")
            else:
                self.id[piece] = k
                score[piece] = sp.get_score(k)
                self.text.append(piece.replace(SPACE, " ").encode())
        self.kind = np.dtype("<u2" if len(self.text) <= 1 << 16 else "<u4")
        joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        stray = sorted({c for c in map(chr, range(128)) if not any(c in two for two in joined)})
        apart = {c for two in joined for c in two if c != SPACE and not c.isalpha()} - set(stray)
        while loose := {c for two in joined for c, other in (two, two[::-1]) if c in apart and other not in apart and two[0] != SPACE}:
            apart -= loose  # those left join each other and a leading space mark, nothing else
        alone, apart = (re.escape("".join(sorted(x))) for x in (stray, apart))
        parts = [f"[{alone}]"] if alone else []
        parts += [f"{SPACE}*[^{SPACE}{alone}{apart}]+"] + ([f"{SPACE}*[{apart}]+"] if apart else []) + [f"{SPACE}+"]
        self.stretch = re.compile("|".join(parts))
        self.rule = PrefixRule({p: -s for p, s in score.items() if len(p) > 1})
        self.ends = self._ends(score)
        self.step = 4 * self.rule.longest  # positions between two looks for a meeting
        self.code = Codes(self._code)
        self.n_commits = 0  # made by meetings of paths
        self._memo = Memo(self.scanned, MEMO, SHORT)

    def _ends(self, pieces):
        """An automaton that names the pieces which end at each place of a stretch, as (length, number), longest first."""
        import ahocorasick

        ends, rule = ahocorasick.Automaton(), self.rule
        for piece in pieces:
            if piece in rule.number:
                ends.add_word(piece, (len(piece), rule.number[piece]))
            elif len(piece) == 1:
                ends.add_word(piece, (1, rule.unit(piece)))
        ends.make_automaton()
        return ends

    def _code(self, number: int) -> bytes:
        piece = self.rule.names[number]
        known = self.id.get(piece)
        ids = [known] if known is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return np.array(ids, dtype=self.kind).tobytes()

    def path_ids(self, last, back, end: int) -> bytes:
        """The ids of the path from a position back to the begin of its entry."""
        path = []
        while end:
            path.append(last[end - 1])
            end = back[end - 1]
        path.reverse()
        return b"".join(map(self.code.__getitem__, path))

    def scanned(self, part: str) -> tuple[bytes, tuple, tuple]:
        """An entry of a window for a whole stretch."""
        last, back, fit, fits, end = [], [], self.rule.fit, self.rule.fits, 1
        for at, (size, number) in self.ends.iter(part):
            if at + 1 == end:
                start = end - size
                if start == 0 or (good := fit.get(last[start - 1] << 32 | number)) or good is None and fits(last[start - 1], number):
                    last.append(number)
                    back.append(start)
                    end += 1
        if end <= len(part):  # from the first character that is no piece on
            last, back = [START, *last], [0, *back]
            self.rule.scan(part, 0, last, back, len(part))
            last, back = last[1:], back[1:]
        return self.path_ids(last, back, len(back)), tuple(last), tuple(back)

    def _long(self, scan: Scan, text: str, window: Window) -> Iterator[bytes]:
        """Goes on in a long stretch, whose positions that are not committed are the window's last entry."""
        for at in range(0, len(text), self.step):
            last, back = scan(text[at : at + self.step])
            if scan.open and window.entries:
                _, before, starts = window.entries.pop()
                last, back = before + last, starts + array("i", [k - scan.base for k in back])
            else:
                scan.base = scan.at + len(scan.tail) - len(last)
                back = array("i", [k - scan.base for k in back])
            scan.open = True
            window.entries.append((self.path_ids(last, back, len(back)), last, back))
            yield window.commit()
            if len(window.entries) == 1 and window.given:  # the entry begins anew at the boundary that was committed
                (_, last, back), path = window.entries[0], []
                end = len(back)
                while end:
                    path.append(end)
                    end = back[end - 1]
                left = window.given
                while left > 0:
                    end = path.pop()
                    left -= len(self.code[last[end - 1]])
                last, back = last[end:], array("i", [k - end for k in back[end:]])
                window.entries[0], window.given = (self.path_ids(last, back, len(back)), last, back), 0
                scan.base += end

    def commits(self, blocks: Iterable[str]) -> Iterator[bytes]:
        """The ids of a text that comes in blocks, given out as soon as all surviving paths agree on them."""
        held, scan, window, entry_of = "", None, Window(self.rule.longest, self.path_ids), self._memo.__getitem__
        for block in chain(blocks, (None,)):
            text = held + (block or "")
            if scan is not None:  # a long stretch is open
                goes = self.stretch.match(scan.tail[-1] + text).end() - 1
                yield from self._long(scan, text[:goes], window)
                if goes == len(text) and block is not None:
                    continue
                text, scan = text[goes:], None
            parts = self.stretch.findall(text)
            held = parts.pop() if parts and block is not None else ""  # the last stretch may go on
            at = 0
            while at < len(parts):
                some = parts[at : at + LOOK]
                at += LOOK
                if len(max(some, key=len)) <= SHORT:
                    window.entries += map(entry_of, some)
                else:
                    for part in some:
                        if len(part) <= SHORT:
                            window.entries.append(entry_of(part))
                        else:
                            yield from self._long(Scan(self.rule), part, window)
                if len(some) == LOOK:
                    yield window.commit()
            if len(held) > SHORT:
                scan = Scan(self.rule)
                yield from self._long(scan, held, window)
                held = ""
        self.n_commits += window.n_commits
        yield window.rest()

    def encode_array(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=self.kind)
        marked = SPACE + text.replace(" ", SPACE)
        blocks = (marked,) if len(marked) <= BLOCK else (marked[at : at + BLOCK] for at in range(0, len(marked), BLOCK))
        return np.frombuffer(b"".join(self.commits(blocks)), dtype=self.kind)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids) -> str:
        """The text of the ids, without the leading space that encoding adds; stray bytes become U+FFFD."""
        raw = b"".join(map(self.text.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the piece ids of each text."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = kept_in_worker(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            for part in slices(batch, 1):
                lists = [model.encode_array(t.as_py()).astype(np.int32) for t in part.column(1)]
                ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["id", "ids"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts of lists of ids."""
    src = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        model = kept_in_worker(("pieces", path), lambda: Pieces(path))
        for batch in batches:
            lists = batch.column(1)
            values, ends = np.asarray(lists.values), np.asarray(lists.offsets)
            texts = [model.decode(values[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, text string")


def round_trips(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_pieces, ids_sha256, decoded_sha256, same): encodes and decodes each text in one pass.

    ids_sha256 is over the ids as little-endian 32-bit integers; `same` tells
    whether decoding gives the text back (the space mark itself reads as a space).
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        model = kept_in_worker(("pieces", path), lambda: Pieces(path))
        for batch in (few for batch in batches for few in slices(batch, 1)):
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                ids = model.encode_array(text)
                again = model.decode(ids.tolist())
                digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                rows.append((len(ids), digest, hashlib.sha256(again.encode()).hexdigest(), again == text))
            columns = [pa.array(list(x), kind) for x, kind in zip(zip(*rows) if rows else ((),) * 4, (pa.int64(), pa.string(), pa.string(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_pieces", "ids_sha256", "decoded_sha256", "same"])

    return src.mapInArrow(run, f"id {dict(src.dtypes)['id']}, n_pieces bigint, ids_sha256 string, decoded_sha256 string, same boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
