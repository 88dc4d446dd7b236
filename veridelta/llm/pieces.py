"""SentencePiece encoding by streaming Viterbi, and decoding.

A text is segmented into vocabulary pieces with the greatest sum of scores, characters without a piece becoming their
UTF-8 bytes. Only positions at which a piece can still begin are open, at most as many as the longest piece has
characters. Once the back pointers of all open positions meet at one boundary, the ids before it are certain: they are
given out, and the window starts there. Before a space mark, and around line ends, no piece of the vocabulary goes on,
so paths meet there in any text and leave the window empty. The ids of such a run are remembered once the window gave
them out, and looked up when the run comes again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

ship(__name__)

SPACE = "▁"
#: Runs that a task remembers: the last MEMO new ones and up to as many before; longer ones than LONG are not. This bounds
#: memory and changes no ids.
MEMO, LONG = 60_000, 200


def load(path: str) -> tuple[list[str], list[float], list[int]]:
    """Pieces, scores and kinds (0 normal, 1 byte, 2 neither) of a SentencePiece model file.

    Only models whose normaliser leaves texts alone but for a space in front are supported.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for probe in ("a  b", " Åﬁ ", "x\ty\n"):
        if sp.decode(sp.encode(probe)) != probe:
            raise ValueError("this model normalises texts")
    n = sp.get_piece_size()
    kinds = [1 if sp.is_byte(i) else 2 if sp.is_control(i) or sp.is_unknown(i) else 0 for i in range(n)]
    return [sp.id_to_piece(i) for i in range(n)], [sp.get_score(i) for i in range(n)], kinds


class Window:
    """The open part of the lattice: characters after the last certain boundary, and the best path to each end."""

    def __init__(self, ends: list, going: set[str], lasts: set[str], longest: int, unknown: float) -> None:
        self.ends, self.going, self.lasts, self.longest, self.unknown = ends, going, lasts, longest, unknown
        self.chars: list[str] = []
        self.best, self.start, self.piece = [0.0], [0], [-1]

    def push(self, text: str) -> None:
        """Adds characters. The best last piece of each end is found backwards; of equal sums the longest wins."""
        chars, best, start, piece, ends, unknown = self.chars, self.best, self.start, self.piece, self.ends, self.unknown
        for c in text:
            chars.append(c)
            i = len(chars) - 1
            node = ends.get(c)
            if node is None or node[1] is None:  # no piece of this one character
                top, at, got = best[i] + unknown, i, -1
            else:
                top, at, got = best[i] + node[1], i, node[2]
            while node is not None and i:
                i -= 1
                node = node[0].get(chars[i])
                if node is not None and node[1] is not None and best[i] + node[1] >= top:
                    top, at, got = best[i] + node[1], i, node[2]
            best.append(top)
            start.append(at)
            piece.append(got)

    def keep(self, n: int) -> None:
        """Forgets all but the first n characters."""
        del self.chars[n:], self.best[n + 1 :], self.start[n + 1 :], self.piece[n + 1 :]

    def meet(self) -> int:
        """The last boundary that the best paths to all open positions share: the end, and where a piece may have begun
        that goes on."""
        n, going = len(self.chars), self.going
        if not n or self.chars[-1] not in self.lasts:
            return n
        tail = "".join(self.chars[-self.longest :])
        live = {n - k for k in range(1, len(tail) + 1) if tail[-k:] in going}
        live.add(n)
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(self.start[last])
        return live.pop()

    def path(self, end: int, byte_id: dict[int, int]) -> list[int]:
        out: list[int] = []
        while end > 0:
            at = self.start[end]
            if self.piece[end] >= 0:
                out.append(self.piece[end])
            else:
                out.extend(byte_id[b] for b in reversed(self.chars[at].encode("utf-8", "surrogatepass")))
            end = at
        out.reverse()
        return out

    def drop(self, n: int) -> None:
        """Starts anew at the n-th boundary, whose ids were given out."""
        del self.chars[:n], self.best[:n], self.piece[:n]
        self.start = [k - n for k in self.start[n:]]


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, vocabulary: tuple[list[str], list[float], list[int]]) -> None:
        pieces, scores, kinds = vocabulary
        normal = [(p, s, i) for i, (p, s, k) in enumerate(zip(pieces, scores, kinds)) if k == 0]
        self.longest = max(len(p) for p, _, _ in normal)
        root: list = [{}, None, -1]  # read backwards: children by character, score and id of the piece that begins here
        for p, s, i in normal:
            node = root
            for c in reversed(p):
                node = node[0].setdefault(c, [{}, None, -1])
            node[1:] = s, i
        self.ends = root[0]
        self.going = {p[:k] for p, _, _ in normal for k in range(1, len(p))}  # what can go on to be a piece
        self.lasts = {p[-1] for p in self.going}
        self.unknown = min(s for _, s, _ in normal) - 10
        self.byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds)) if k == 1}
        self.out = [bytes([int(p[3:5], 16)]) if k == 1 else b"" if k == 2 else p.replace(SPACE, " ").encode() for p, k in zip(pieces, kinds)]
        # boundaries that no piece spans, whatever the text: before a space mark that doesn't follow one, and around line ends
        long = [p for p, _, _ in normal if len(p) > 1]
        free = any(SPACE in p.lstrip(SPACE) for p in long) or any("\n" in p for p in long)
        self.runs = None if free else re.compile(rf"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
        self.memo: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}

    def window(self) -> Window:
        return Window(self.ends, self.going, self.lasts, self.longest, self.unknown)

    def stream(self, text: str) -> Iterator[list[int]]:
        """Ids of text in parts, each given out once it is certain."""
        w, step = self.window(), 4 * self.longest
        for k in range(0, len(text), step):
            w.push(text[k : k + step])
            if meet := w.meet():
                yield w.path(meet, self.byte_id)
                w.drop(meet)
        yield w.path(len(w.chars), self.byte_id)

    def learn(self, runs: list[str]) -> None:
        """Remembers the ids of runs. In sorted order, a run's window starts from that of the one before as far as their
        beginnings agree. A line end pushed behind it closes all pieces, so that the paths must meet at its end."""
        if len(self.memo) + len(runs) > MEMO:
            self.memo, self.older = {}, self.memo
        w, last = self.window(), ""
        for s in sorted(runs):
            n = 0
            for x, y in zip(s, last):
                if x != y:
                    break
                n += 1
            w.keep(n)
            w.push(s[n:] + "\n")
            if w.meet() < len(s):
                raise AssertionError("a piece goes on beyond the run")
            self.memo[s] = w.path(len(s), self.byte_id)
            last = s

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. Runs that were not seen are learned first; those beyond LONG characters stream each time."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        if self.runs is None:
            return [[i for part in self.stream(m) for i in part] for m in marked]
        cut = [self.runs.findall(m) for m in marked]
        new = {s for c in cut for s in c if s not in self.memo and len(s) <= LONG}
        known = {s: self.older[s] for s in new if s in self.older}
        self.learn([s for s in new if s not in known])
        memo = self.memo
        memo.update(known)
        older = self.older
        out = []
        for c in cut:
            ids: list[int] = []
            for s in c:
                if (found := memo.get(s)) is None and (found := older.get(s)) is None:
                    for part in self.stream(s):
                        ids += part
                else:
                    ids += found
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        table = self.out
        text = b"".join([table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, vocabulary: tuple[list[str], list[float], list[int]], id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """id, n_ids, ids_sha256 (of 32-bit little-endian ids), decoded_sha256, round_trip; and the ids themselves if asked for.

    round_trip says whether decoding gives the text again. It is false only for texts with the space mark U+2581, which
    the format can't tell from a space. Null and empty texts have no ids and round-trip to the empty text. The id may be
    null and rows may repeat; an empty table gives an empty result. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for b in batches:
            for k in range(0, b.num_rows, 200):  # ids take more room than texts
                part = b.slice(k, 200)
                cols: list[list] = [[] for _ in range(5)]
                texts = [t.as_py() or "" for t in part.column(1)]
                for text, found in zip(texts, codec.encode_all(texts)):
                    back = codec.decode(found)
                    arr = np.array(found, "<i4")
                    row = (len(found), hashlib.sha256(arr.tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back == text, arr)
                    for c, v in zip(cols, row):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.int32()))
                names = ["n_ids", "ids_sha256", "decoded_sha256", "round_trip", "ids"]
                made = [pa.array(c, t) for c, t in zip(cols, kinds)][: 5 if ids else 4]
                yield pa.RecordBatch.from_arrays([part.column(0), *made], [id_col, *names[: len(made)]])

    return docs.select(id_col, "text").mapInArrow(each, f"{id_col} {kind}, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean" + (", ids array<int>" if ids else ""))


def tokenizer_path(folder: str = "/opt/tokenizers", name: str = "piece_bpe_32k.model") -> str:
    return f"{folder}/{name}"
