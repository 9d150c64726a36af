"""The piece vocabulary of a SentencePiece BPE model: which pieces may follow each other, worked out from its scores.

BPE merges the adjacent pair with the highest score, the leftmost first. Two facts turn this into a lattice:

* a text's encoding is the one path of pieces in which every two neighbours, encoded alone, stay as they are;
* a piece holds only neighbouring characters that some piece holds, so a border is sure between any others (before a
  space mark after another character, around a character outside the vocabulary, mostly before a full stop): a text falls apart
  there into parts that are encoded independently.

Both are checked when a model is loaded (the second) and by the tests against the library (both).
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

MARK = "▁"
#: Words that are remembered for each worker; beyond it the older half goes, which costs time only.
MEMO = 450_000


_BYTES = re.compile("[\udc80-\udcff]")


class Follower(dict):
    """follower[a][b]: whether b may stand right after a; worked out at its first use, emptied when it holds too much."""

    MOST = 400_000

    def __init__(self, pieces: Pieces):
        self.pieces, self.held = pieces, 0

    def __missing__(self, a: str):
        out = self[a] = _After(self, a)
        return out


class _After(dict):
    def __init__(self, of: Follower, a: str):
        self.of, self.a = of, a

    def __missing__(self, b: str) -> bool:
        of = self.of
        if of.held >= of.MOST:
            of.clear()
            of.held = 0
        of.held += 1
        out = self[b] = of.pieces.may_follow(self.a, b)
        return out


class Pieces:
    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, kind = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("a BPE model without text normalisation is needed")
        if not proto.trainer_spec.byte_fallback:
            raise ValueError("a model with byte fallback is needed")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == kind.NORMAL}
        self.bytes_ = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        #: What an id decodes to; a byte beyond ASCII as a lone surrogate, until it is put together with its neighbours.
        self.show = ["" if p.type == kind.CONTROL else p.piece for p in proto.pieces]
        for b, i in self.bytes_.items():
            self.show[i] = chr(b) if b < 0x80 else chr(0xDC00 + b)
        if any(p.type == kind.USER_DEFINED for p in proto.pieces) or any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("pieces may hold space marks at their start only, and none may be user defined")
        self.longest = max(map(len, self.ids), default=1)
        #: Neighbours inside pieces: between any others there is a border.
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.chars = {c for p in self.ids if len(p) == 1 for c in p}
        #: The longest piece that ends with a character.
        self.longest_at: dict[str, int] = {}
        for p in self.ids:
            self.longest_at[p[-1]] = max(len(p), self.longest_at.get(p[-1], 1))
        #: What a piece may have begun with.
        self.stems = {p[:i] for p in self.ids for i in range(1, len(p))}
        self.follower = Follower(self)
        self.follows = lambda a, b: self.follower[a][b]

    def merged(self, word: str) -> list[str]:
        """The BPE encoding by its definition; quadratic, for short strings."""
        s, scores = list(word), self.scores
        while len(s) > 1:
            best, at = None, -1
            for i in range(len(s) - 1):
                score = scores.get(s[i] + s[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def may_follow(self, a: str, b: str) -> bool:
        """Whether piece b (or a lone character) may stand right after a; a is empty at a word's start."""
        return self.merged(a + b) == ([a, b] if a else [b])

    def token_ids(self, piece: str) -> tuple[int, ...]:
        i = self.ids.get(piece)
        return (i,) if i is not None else tuple(self.bytes_[b] for b in piece.encode("utf-8", "replace"))

    def width(self, piece: str) -> int:
        """The tokens that a piece or lone character gives."""
        return 1 if piece in self.ids else len(piece.encode("utf-8", "replace"))

    def marked(self, text: str) -> str:
        return self.prefix + text.replace(" ", MARK) if text else ""

    def decode(self, ids) -> str:
        """The library's decoding: bytes are put together, marks become spaces, the first one is dropped."""
        show = self.show
        text = "".join([show[i] for i in ids])
        if _BYTES.search(text):
            text = text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")
        text = text.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def breaks(self, text: str, i: int) -> bool:
        """Whether marked text surely has a token border right before position i."""
        return i == 0 or text[i - 1 : i + 1] not in self.pairs


#: The start state: no characters, and one place where a piece may begin.
START = ("", ((0, "", 0),))
#: Compiled transitions that are kept for each worker.
MOST = 400_000


class Transducer:
    """The vocabulary compiled into a deterministic transducer over characters, as far as texts have needed it.

    A state is what the future can depend on: the last characters as far back as a piece may still be under way, and for each
    place where one may have begun the last token before it and how many tokens fewer the encoding has there. A
    transition carries the tokens that a further character adds (it may be negative, when tokens merge) and the
    length of the last token of the encoding up to it.
    """

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self._empty()

    def _empty(self) -> None:
        self.states = {START: 0}
        self.keys = [START]
        #: By character, then by state: most states have one way on, and a table for each would hold more than it does.
        self.moves: dict[str, dict[int, tuple[int, int, int]]] = defaultdict(dict)
        self.size = 0

    def _compiled(self, state: int, c: str) -> tuple[int, int, int]:
        """The transition from a state over a character: the next state, the tokens it adds, the last token's length."""
        p = self.pieces
        tail, starts = self.keys[state]
        if tail and p.breaks(tail[-1] + c, 1):
            tail, starts = START
        tail, size = tail + c, len(tail)
        for n, before, count in starts:
            piece = tail[size - n :]
            if (n == 0 or piece in p.ids) and p.follower[before][piece]:
                break
        else:
            raise AssertionError("every prefix has an encoding")
        adds = count + p.width(piece)
        live = [(n + 1, before, count - adds) for n, before, count in starts if tail[size - n :] in p.stems]
        key = (tail[size + 1 - live[0][0] :] if live else c, (*live, (0, piece, 0))) if c in p.chars else START
        to = self.states.setdefault(key, len(self.keys))
        if to == len(self.keys):
            self.keys.append(key)
        self.size += 1
        move = self.moves[c][state] = (to, adds, len(piece))
        return move

    def run(self, text: str) -> int:
        """Tokens of marked text, from the start state."""
        if self.size >= MOST:
            self._empty()
        state = total = 0
        moves = self.moves
        for c in text:
            move = moves[c].get(state)
            if move is None:
                move = self._compiled(state, c)
            state = move[0]
            total += move[1]
        return total

    def ids(self, text: str) -> tuple[int, ...]:
        """Token ids of marked text: the last tokens are noted on the way and read backwards."""
        if self.size >= MOST:
            self._empty()
        state, moves, sizes = 0, self.moves, []
        for c in text:
            move = moves[c].get(state)
            if move is None:
                move = self._compiled(state, c)
            state = move[0]
            sizes.append(move[2])
        out: list[int] = []
        end, known = len(text), self.pieces.ids
        while end:
            piece = text[end - sizes[end - 1] : end]
            i = known.get(piece)
            if i is None:
                out += reversed(self.pieces.token_ids(piece))
            else:
                out.append(i)
            end -= len(piece)
        out.reverse()
        return tuple(out)


_WORD = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*|[^{MARK}\n]+")


def words_of(pieces: Pieces, text: str) -> list[str]:
    """Words of a text whose encodings, put together, are the text's: keys for a memo.

    In a key, a leading \\x00 stands for a line feed and a leading \\x01 for nothing; any other key begins after a mark.
    """
    if not text:
        return []
    if pieces.prefix and text[0] != " " and "  " not in text and MARK not in text and "\x00" not in text and "\x01" not in text:
        return (text.replace("\n", " \x00") if "\n" in text else text).split(" ")
    return ["\x01" + w for w in _WORD.findall(pieces.marked(text))]


def word_text(key: str) -> str:
    """The marked text that a key stands for."""
    return "\n" + key[1:] if key.startswith("\x00") else key[1:] if key.startswith("\x01") else MARK + key


class Memo(dict):
    """key -> value of a word, worked out at its first use; bounded. A closing mark is taken off first where a border is sure."""

    def __init__(self, work, breaks):
        self.work, self.breaks = work, breaks

    def __missing__(self, key):
        if len(self) >= MEMO:
            for old in list(islice(self, MEMO // 2)):
                del self[old]
        if len(key) > 2 and key[-1] in ".,;:!?" and self.breaks(key, len(key) - 1):
            value = self[key[:-1]] + self["\x01" + key[-1]]
        else:
            value = self.work(word_text(key))
        self[key] = value
        return value
