"""Byte-pair encoding by backtracking over longest matches, and decoding through an offset table.

A sequence of tokens is the one that the merges give exactly when every adjacent pair is compatible, that is, when merging the two
tokens' bytes alone gives these two tokens back. An Aho-Corasick automaton finds the longest token at every place; the encoder takes it if
it is compatible with the token before, else the next shorter one, and steps back where none is left. A place that failed is never
tried again, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import tokenizer_path

#: Units that a task remembers; beyond, it starts anew.
REMEMBERED = 600_000
#: Pre-tokens up to this many bytes are encoded side by side, longer ones one by one.
SIDE_BY_SIDE = 64
_SIDE_ROWS = 8192
#: Tokens decoded at a time.
_DECODED = 1 << 18
_MEMO_BITS = 20
#: White space as the tokenizer's pattern sees it. A unit is a run of other characters with one space before it at most:
#: no pre-token crosses the end of such a run, and what a unit becomes does not depend on its neighbours.
_SPACE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Fixed value: the published pre-token pattern of this family of vocabularies.
_PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose classes are the same in every Unicode version at hand; other units are cut by the library itself.
_PLAIN = re.compile(f"[{chr(0)}-{chr(0x24F)}]*")
#: A unit that is a single pre-token: Latin letters only.
_LETTERS = re.compile(f" ?[A-Za-z{chr(0xC0)}-{chr(0xD6)}{chr(0xD8)}-{chr(0xF6)}{chr(0xF8)}-{chr(0x24F)}]+")


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself, or the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tables of a byte-level BPE file. Inside, bytes are tokens 0 to 255 and merge i makes token 256 + i."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as lines:
            spec = json.load(lines)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        outer = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.bytes = [bytes([b]) for b in range(256)] + [raw(a) + raw(b) for a, b in merges]
        inner = {b: t for t, b in enumerate(self.bytes)}
        if len(inner) != len(self.bytes) or any(b not in outer for b in self.bytes):
            raise ValueError("merges must make distinct tokens of the vocabulary")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.outer = np.array([outer[b] for b in self.bytes], np.uint32)
        self.left = np.array([*range(256), *(inner[raw(a)] for a, _ in merges)], np.int64)
        self.right = np.array([*range(256), *(inner[raw(b)] for _, b in merges)], np.int64)
        self.length = np.array([len(b) for b in self.bytes], np.int64)
        made = np.arange(256, len(self.bytes))
        pairs = self.left[256:] << 20 | self.right[256:]
        order = np.argsort(pairs)
        self.pair_keys, self.pair_made = pairs[order], made[order]
        self.memo_key = np.full(1 << _MEMO_BITS, -1, np.int64)
        self.memo_fits = np.zeros(1 << _MEMO_BITS, bool)
        # a token that its own bytes do not merge into is never output, so it is no candidate either
        self.usable = np.ones(len(self.bytes), bool)
        self.usable[256:] = self._check(self.left[256:], self.right[256:], made)
        self._automaton()
        self.shorter = self._next_shorter()
        self._offsets(spec, outer)

    def _automaton(self) -> None:
        """Aho-Corasick over reversed tokens: read from the end, its state at a place tells the longest token that begins there."""
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for t, b in enumerate(self.bytes):
            if not self.usable[t]:
                continue
            at = 0
            for c in reversed(b):
                nxt = children[at].get(c)
                if nxt is None:
                    nxt = children[at][c] = len(children)
                    children.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = t
        step = np.zeros((len(children), 256), np.int32)
        for c, nxt in children[0].items():
            step[0, c] = nxt
        level = [(nxt, 0) for nxt in children[0].values()]
        while level:  # breadth first, with the state to fall back to
            below = []
            for at, back in level:
                step[at] = step[back]
                if ends[at] < 0:
                    ends[at] = ends[back]
                for c, nxt in children[at].items():
                    below.append((nxt, int(step[back, c])))
                    step[at, c] = nxt
            level = below
        self.step, self.longest = step, np.array(ends, np.int64)

    def _next_shorter(self) -> np.ndarray:
        """For each token the longest usable token that is a proper prefix of it, or -1."""
        known = {b: t for t, b in enumerate(self.bytes) if self.usable[t]}
        return np.array([next((known[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in known), -1) for b in self.bytes], np.int64)

    def _offsets(self, spec: dict, outer: dict[bytes, int]) -> None:
        by_id = {i: b for b, i in outer.items()} | {i: s.encode() for s, i in self.special.items()}
        sizes = np.zeros(max(by_id) + 2, np.int64)
        for i, b in by_id.items():
            sizes[i + 1] = len(b)
        self.begin = np.cumsum(sizes)
        self.blob = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(sizes) - 1)), np.uint8)

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The token that merging each pair makes, a very large number where none does."""
        keys = a << 20 | b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_made[at], 1 << 40)

    def _check(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether each pair stays apart under the merges before ``below`` (default: all).

        Undoes merges across the border, the latest first: if the two tokens that meet there could merge earlier than the merge just
        undone, the pair would not have come about.
        """
        a, b, fits = a.copy(), b.copy(), np.ones(len(a), bool)
        limit = np.full(len(a), 1 << 39) if below is None else below.copy()
        open_ = np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            early = self._merged(x, y) < limit[open_]
            fits[open_[early]] = False
            go = ~early
            open_, x, y = open_[go], x[go], y[go]
            undo_left = (x > y) & (x > 255) | (y < 256)
            done = (x < 256) & (y < 256)
            limit[open_] = np.where(undo_left, x, y + 1)
            a[open_] = np.where(undo_left, self.right[x], x)
            b[open_] = np.where(undo_left, y, self.left[y])
            open_ = open_[~done]
        return fits

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pair-compatibility table: answers are kept by pair, and worked out when first asked for."""
        keys = a << 20 | b
        slot = ((keys * 0x9E3779B97F4A7C1 & (1 << 62) - 1) >> 62 - _MEMO_BITS).astype(np.int64)
        fits, fresh = self.memo_fits[slot], np.flatnonzero(self.memo_key[slot] != keys)
        if len(fresh):
            fits[fresh] = self._check(a[fresh], b[fresh])
            self.memo_fits[slot[fresh]] = fits[fresh]
            self.memo_key[slot[fresh]] = -1  # two fresh pairs may share a slot: keep the one written last, with its own answer
            self.memo_key[slot[fresh]] = keys[fresh]
        return fits

    def encode_long(self, piece: bytes) -> np.ndarray:
        """Tokens of one piece, place by place."""
        n = len(piece)
        longest = np.empty(n, np.int64)
        state, step = 0, self.step
        for at in range(n - 1, -1, -1):
            state = step[state, piece[at]]
            longest[at] = self.longest[state]
        alive, tokens, at, known = bytearray(b"\x01") * (n + 1), [], 0, {}
        longest, length, shorter = longest.tolist(), self.length, self.shorter
        token = longest[0] if n else -1
        while at < n:
            end = at + int(length[token])
            fits = alive[end]
            if fits and tokens:
                pair = (tokens[-1], token)
                fits = known.get(pair)
                if fits is None:
                    fits = known[pair] = bool(self.compatible(np.array([pair[0]]), np.array([pair[1]]))[0])
            if fits:
                tokens.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = int(shorter[token])
            else:
                alive[at] = 0
                token = tokens.pop()
                at -= int(length[token])
        return np.array(tokens, np.int64)

    def _encode_side_by_side(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (padded rows) and their numbers, for short pieces: every round moves all open pieces by one trial."""
        rows, wide = len(pieces), max(map(len, pieces))
        sizes = np.fromiter(map(len, pieces), np.int64, rows)
        letters = np.frombuffer(b"".join(p.ljust(wide, b"\0") for p in pieces), np.uint8).reshape(rows, wide)
        longest = np.zeros((rows, wide), np.int64)
        state = np.zeros(rows, np.int64)
        for at in range(wide - 1, -1, -1):
            state = np.where(sizes > at, self.step[state, letters[:, at]], 0)
            longest[:, at] = self.longest[state]
        tokens, depth, place = np.zeros((rows, wide + 1), np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
        alive = np.ones((rows, wide + 1), bool)
        token, open_ = longest[:, 0].copy(), np.arange(rows)
        while len(open_):
            now, deep, at = token[open_], depth[open_], place[open_]
            end = at + self.length[now]
            fits = alive[open_, end]
            ask = np.flatnonzero(fits & (deep > 0))
            if len(ask):
                fits[ask] = self.compatible(tokens[open_[ask], deep[ask] - 1], now[ask])
            good = open_[fits]
            tokens[good, depth[good]] = now[fits]
            depth[good] += 1
            place[good] = end[fits]
            token[good] = longest[good, np.minimum(end[fits], wide - 1)]
            less = self.shorter[now]
            try_less = ~fits & (less >= 0)
            token[open_[try_less]] = less[try_less]
            back = open_[~fits & (less < 0)]
            if len(back):
                alive[back, place[back]] = False
                depth[back] -= 1
                token[back] = tokens[back, depth[back]]
                place[back] -= self.length[token[back]]
            open_ = open_[place[open_] < sizes[open_]]
        return tokens, depth

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary ids of all pre-tokens one after the other, and the place where each begins (and the last ends)."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(sizes, kind="stable")
        short = order[(sizes[order] > 0) & (sizes[order] <= SIDE_BY_SIDE)]
        counts, parts = np.zeros(len(pieces), np.int64), []
        for at in range(0, len(short), _SIDE_ROWS):
            some = short[at:at + _SIDE_ROWS]
            tokens, counts[some] = self._encode_side_by_side([pieces[i] for i in some.tolist()])
            parts.append((some, tokens))
        for i in order[sizes[order] > SIDE_BY_SIDE].tolist():
            tokens = self.encode_long(pieces[i])
            counts[i] = len(tokens)
            parts.append((np.array([i]), tokens[None]))
        begin = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(begin[-1], np.uint32)
        for some, tokens in parts:
            place = np.arange(tokens.shape[1])
            row, column = np.nonzero(place < counts[some][:, None])
            out[begin[some][row] + column] = self.outer[tokens[row, column]]
        return out, begin

    def pre_tokens(self, unit: str) -> list[bytes]:
        if _LETTERS.fullmatch(unit):
            return [unit.encode()]
        if _PLAIN.fullmatch(unit):
            return [x.encode() for x in _PRE_TOKEN.findall(unit)]
        return [unit[a:b].encode() for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(unit)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the tokens: one blob of all tokens is read at the places that the offset table gives."""
        parts = []
        for at in range(0, len(ids), _DECODED):
            some = ids[at:at + _DECODED].astype(np.int64)
            begin = self.begin[some]
            sizes = self.begin[some + 1] - begin
            ends = np.cumsum(sizes)
            parts.append(self.blob[np.repeat(begin - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        return b"".join(parts)


class Encoder:
    """Encodes texts, remembering units; special tokens' strings inside texts are special, as the library has it."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.raw: dict[str, bytes] = {}
        self.decimal = [str(i) for i in range(len(self.vocabulary.begin) - 1)]

    def _learn(self, units: set[str]) -> None:
        fresh = [u for u in units if u not in self.raw]
        if len(self.raw) + len(fresh) > REMEMBERED:
            self.raw.clear()
            fresh = list(units)
        units = fresh
        if not units:
            return
        cut = [self.vocabulary.pre_tokens(u) for u in units]
        ids, begin = self.vocabulary.encode_pieces([p for pieces in cut for p in pieces])
        ends = begin[np.cumsum([len(pieces) for pieces in cut])].tolist()
        raw, at = ids.astype("<u4").tobytes(), 0
        for unit, end in zip(units, ends, strict=True):
            self.raw[unit] = raw[4 * at:4 * end]
            at = end

    def _units(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return _UNIT.findall(text)
        units = []
        for i, part in enumerate(self.special.split(text)):
            units += [("", part)] if i % 2 else _UNIT.findall(part)  # a pair marks a special token
        return units

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """For each text its ids as little-endian uint32."""
        cut = [self._units(t) for t in texts]
        self._learn({u for units in cut for u in units if type(u) is str})
        for special, number in self.vocabulary.special.items():
            self.raw["", special] = number.to_bytes(4, "little")
        for units in cut:
            yield b"".join(map(self.raw.__getitem__, units))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Texts are encoded together up to so many characters.
_TOGETHER = 1 << 20


def _together(texts: list[str | None]) -> Iterator[list[str]]:
    group, held = [], 0
    for t in texts:
        t = t or ""
        if group and held + len(t) > _TOGETHER:
            yield group
            group, held = [], 0
        group.append(t)
        held += len(t)
    if group:
        yield group


def encoded(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the token ids of every whole text as ``ids`` (array of int). A null text gives an empty array; other columns pass through."""
    path = path or tokenizer_path()

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [np.frombuffer(raw, "<u4").astype(np.int32) for g in _together(texts.to_pylist()) for raw in encoder(path).encode(g)]
            yield pa.array(found, pa.list_(pa.int32()))

    return docs.withColumn(ids, encode(F.col(text)))


def decoded(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the text of an array of ids, special tokens included; bytes that are no UTF-8 become U+FFFD. Null ids give an empty text."""
    path = path or tokenizer_path()

    @F.arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arrays in batches:
            vocabulary = encoder(path).vocabulary
            yield pa.array([vocabulary.decode(np.array(x.as_py() or [], np.int64)).decode(errors="replace") if x.is_valid else "" for x in arrays], pa.string())

    return rows.withColumn(text, decode(F.col(ids)))


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Encode and decode every whole text, and add ``n_tokens``, ``ids_sha256`` (of decimal ids joined by commas) and ``decoded_sha256``.

    One pass: the ids never leave the Arrow function. A null text counts as empty; columns of these names are replaced, repeated rows
    are done each, an empty table gives an empty result.
    """
    path = path or tokenizer_path()

    @F.arrow_udf("struct<n_tokens:long,ids_sha256:string,decoded_sha256:string>")
    def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            known, rows = encoder(path), []
            for group in _together(texts.to_pylist()):
                for raw in known.encode(group):
                    ids = np.frombuffer(raw, "<u4")
                    shown = ",".join(map(known.decimal.__getitem__, ids.tolist()))
                    back = known.vocabulary.decode(ids).decode(errors="replace")
                    rows.append((len(ids), hashlib.sha256(shown.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    done = docs.withColumn("_trip", digest(F.col(text)))
    return done.withColumns({c: F.col(f"_trip.{c}") for c in ("n_tokens", "ids_sha256", "decoded_sha256")}).drop("_trip")
