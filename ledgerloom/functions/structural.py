"""Structural index of many JSON texts at once: bitmaps, depths by prefix sums, spans.

A batch of texts is one byte buffer. Bitmaps of escapes, quotes, brackets and delimiters are computed
over the whole buffer, whether a byte is inside a string by a prefix sum of quotes, nesting depth by a
prefix sum of brackets. Tokens, their containers and their values' spans follow by sorting and gathering;
no text is walked byte by byte in Python. The index also decides which texts are valid JSON (RFC 8259):
a text with any fault yields no nodes.
"""

from __future__ import annotations

import json
import re

import numpy as np

OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA, STRING, SCALAR = range(8)
_OPS = np.full(256, 255, np.uint8)
for _c, _k in zip(b"{}[]:,", (OPEN_OBJ, CLOSE_OBJ, OPEN_ARR, CLOSE_ARR, COLON, COMMA)):
    _OPS[_c] = _k
_SPACE = np.isin(np.arange(256), list(b" \t\n\r"))
_ESCAPES = np.isin(np.arange(256), list(b'"\\/bfnrtu'))
_HEX = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))
_SCALAR = re.compile(rb"(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\Z")
#: Scalars up to this length are read side by side, a byte of each at a time; longer ones, all of them numbers, singly.
_WIDE = 32


def _number_steps() -> np.ndarray:
    """The next state by state and byte of a number: 0 fault, 1 start, 2 after the sign, 3 zero, 4 whole digits, 5 point, 6 fraction, 7 e, 8 its sign, 9 exponent."""
    steps = np.zeros((10, 256), np.uint8)
    digits, nonzero = list(range(0x30, 0x3A)), list(range(0x31, 0x3A))
    for state, to in ((1, 3), (2, 3)):
        steps[state, 0x30] = to
        steps[state, nonzero] = 4
    steps[1, ord("-")] = 2
    for state, to in ((4, 4), (5, 6), (6, 6), (7, 9), (8, 9), (9, 9)):
        steps[state, digits] = to
    for state in (3, 4, 6):
        steps[state, [ord("e"), ord("E")]] = 7
    steps[[3, 4], ord(".")] = 5
    steps[7, [ord("+"), ord("-")]] = 8
    return steps


_STEPS = _number_steps()
_WORDS = [np.frombuffer(w, np.uint8) for w in (b"true", b"false", b"null")]


def _fine_scalars(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each span is a number, true, false or null."""
    size = end - start
    fine = np.zeros(len(start), bool)
    long = np.flatnonzero(size > _WIDE)
    fine[long] = [bool(_SCALAR.match(buf[start[i] : end[i]].tobytes())) for i in long]
    todo = np.flatnonzero(size <= _WIDE)
    for word in _WORDS:
        at = todo[size[todo] == len(word)]
        fine[at] |= (buf[start[at][:, None] + np.arange(len(word))] == word).all(axis=1)
    at = todo[~fine[todo]]
    state = np.ones(len(at), np.uint8)
    for k in range(int(size[at].max()) if len(at) else 0):
        live = size[at] > k
        state[live] = _STEPS[state[live], buf[start[at[live]] + k]]
    fine[at] = np.isin(state, (3, 4, 6, 9))
    return fine


class Index:
    """Nodes (values) of the valid texts of a batch, in text order.

    doc, kind, start, end (bytes of the value; of strings without quotes), parent (node or -1),
    position (in its array or object), key_start, key_end (member name, -1 in arrays), first of each
    document in ``root`` (-1 if the text is invalid).
    """

    def __init__(self, texts: list[bytes]) -> None:
        self.data = data = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(data, np.uint8)
        lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        first = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        n_docs, size = len(texts), len(buf) if len(texts) else 0
        buf = buf[:size]
        at = np.arange(size, dtype=np.int64)
        doc_of = np.repeat(np.arange(n_docs, dtype=np.int32), lengths + 1)
        bad = np.zeros(n_docs, bool)

        # Bitmaps: a byte is escaped if an odd run of backslashes ends before it.
        slash = buf == 0x5C
        last_other = np.maximum.accumulate(np.where(slash, -1, at)) if size else at
        run = np.zeros(size, np.int64)
        run[1:] = at[1:] - 1 - last_other[:-1]
        escaped = (run & 1) == 1
        quote = (buf == 0x22) & ~escaped
        quotes = np.cumsum(quote, dtype=np.int32)
        base = np.where(first > 0, quotes[first - 1], 0).astype(np.int32) if n_docs else np.zeros(0, np.int32)
        inside = ((quotes - base[doc_of]) & 1) == 1 if size else np.zeros(0, bool)
        if n_docs:
            bad |= inside[first + lengths]  # a string that never ends

        # Faults within strings.
        fault = inside & (buf < 0x20)
        fault |= inside & escaped & ~_ESCAPES[buf]
        u = np.flatnonzero(inside & escaped & (buf == 0x75))
        if len(u):
            four = u[:, None] + np.arange(1, 5)
            fault[u] |= ~(_HEX[buf[np.minimum(four, size - 1)]] & (four < size)).all(axis=1)
        bad[doc_of[fault]] = True

        op = ~inside & ~quote & (_OPS[buf] != 255)
        opening = quote & inside
        scalar = ~inside & ~quote & ~op & ~_SPACE[buf]
        scalar_start = scalar.copy()
        scalar_start[1:] &= ~scalar[:-1]
        pos = np.flatnonzero(op | opening | scalar_start)
        kind = np.where(opening[pos], STRING, np.where(scalar_start[pos], SCALAR, _OPS[buf[pos]])).astype(np.int8)
        doc = doc_of[pos]
        n = len(pos)
        quote_at = np.flatnonzero(quote)
        end = pos + 1
        s = np.flatnonzero(kind == STRING)
        after = np.searchsorted(quote_at, pos[s], "right")
        end[s] = np.where(after < len(quote_at), quote_at[np.minimum(after, max(len(quote_at) - 1, 0))], size) if len(s) else end[s]
        c = np.flatnonzero(kind == SCALAR)
        stop = np.flatnonzero(scalar & ~np.append(scalar[1:], False)) if size else pos
        end[c] = stop[np.searchsorted(stop, pos[c])] + 1 if len(c) else end[c]
        bad[doc[c[~_fine_scalars(buf, pos[c], end[c])]]] = True

        # Depth by prefix sums; the level of a bracket is that of the value it delimits.
        opener, closer = (kind == OPEN_OBJ) | (kind == OPEN_ARR), (kind == CLOSE_OBJ) | (kind == CLOSE_ARR)
        depth = np.cumsum(opener.astype(np.int32) - closer)
        head = np.searchsorted(doc, np.arange(n_docs))
        tail = np.searchsorted(doc, np.arange(n_docs), "right")
        if n:
            before = np.where(head > 0, depth[np.maximum(head, 1) - 1], 0)
            depth = depth - before[doc]
        level = depth - opener
        bad[doc[depth < 0]] = True
        bad |= head == tail
        has = head < tail
        if n:
            bad[has] |= depth[tail[has] - 1] != 0

        # Container of each token: the latest opener one level up; for closers, the bracket they close.
        o = np.flatnonzero(opener)
        ids = np.concatenate([o, np.arange(n)])
        rank = np.concatenate([level[o] + 1, np.where(closer, level + 1, level)])
        order = np.lexsort((np.concatenate([np.zeros(len(o), np.int8), np.ones(n, np.int8)]), ids, rank))
        is_container = order < len(o)
        latest = np.maximum.accumulate(np.where(is_container, np.arange(len(order)), -1)) if len(order) else np.zeros(0, np.int64)
        own = ~is_container
        container = np.full(n, -1, np.int64)
        src = latest[own]
        found = np.where(src >= 0, ids[order[np.maximum(src, 0)]], -1)
        container[ids[order[own]]] = found
        container[(level == 0) & ~closer] = -1
        lost = (container < 0) & (closer | (level > 0))
        lost |= (container >= 0) & (doc[np.maximum(container, 0)] != doc)
        bad[doc[lost]] = True

        # Which token may follow which, in its container.
        holds = np.where(container >= 0, kind[np.maximum(container, 0)], -1)
        start_of_doc = np.zeros(n, bool)
        start_of_doc[head[has]] = True
        prev = np.concatenate([[-1], kind[:-1]]).astype(np.int8) if n else kind
        prev[start_of_doc] = -1
        key = (kind == STRING) & (holds == OPEN_OBJ) & ((prev == OPEN_OBJ) | (prev == COMMA))
        prev_key = np.concatenate([[False], key[:-1]]) if n else key
        value = ((kind == STRING) & ~key) | (kind == SCALAR) | opener
        ended = ((prev == STRING) & ~prev_key) | (prev == SCALAR) | (prev == CLOSE_OBJ) | (prev == CLOSE_ARR)
        ok = np.where(prev == -1, value, False)
        ok |= (prev == OPEN_OBJ) & (key | ((kind == CLOSE_OBJ) & (holds == OPEN_OBJ)))
        ok |= (prev == OPEN_ARR) & (value | ((kind == CLOSE_ARR) & (holds == OPEN_ARR)))
        ok |= (prev == COMMA) & np.where(holds == OPEN_OBJ, key, value)
        ok |= (prev == COLON) & value
        ok |= prev_key & (kind == COLON)
        ok |= ended & (((kind == COMMA) & (holds >= 0)) | ((kind == CLOSE_OBJ) & (holds == OPEN_OBJ)) | ((kind == CLOSE_ARR) & (holds == OPEN_ARR)))
        bad[doc[~ok]] = True
        last = tail[has] - 1
        bad[doc[last[(kind[last] == COMMA) | (kind[last] == COLON)]]] = True

        # Nodes: values of valid texts, with links to their parents.
        closes = np.full(n, -1, np.int64)
        k = np.flatnonzero(closer & (container >= 0))
        closes[container[k]] = k
        t = np.flatnonzero(value & ~bad[doc])
        node_of = np.full(n + 1, -1, np.int64)
        node_of[t] = np.arange(len(t))
        self.valid = ~bad
        self.kind, self.doc = kind[t], doc[t]
        self.start = pos[t] + (self.kind == STRING)
        self.end = end[t].copy()
        brackets = opener[t]
        self.end[brackets] = end[closes[t[brackets]]]
        self.parent = node_of[container[t]]
        member = self.parent >= 0
        member[member] = self.kind[self.parent[member]] == OPEN_OBJ
        names = np.where(member, t - 2, 0)
        self.key_start = np.where(member, pos[names] + 1, -1) if n else self.start
        self.key_end = np.where(member, end[names], -1) if n else self.start
        by_parent = np.lexsort((np.arange(len(t)), self.parent))
        p = self.parent[by_parent]
        new = np.concatenate([[True], p[1:] != p[:-1]]) if len(p) else np.zeros(0, bool)
        starts = np.maximum.accumulate(np.where(new, np.arange(len(p)), 0)) if len(p) else np.zeros(0, np.int64)
        self.position = np.zeros(len(t), np.int64)
        self.position[by_parent] = np.arange(len(p)) - starts
        self.root = np.full(n_docs, -1, np.int64)
        tops = np.flatnonzero(self.parent < 0)
        self.root[self.doc[tops]] = tops
        self._buf = buf
        self._slash = np.concatenate([[0], np.cumsum(slash)]) if size else np.zeros(1, np.int64)

    def named(self, name: str) -> np.ndarray:
        """Whether each node is a member called ``name``."""
        want = np.frombuffer(name.encode(), np.uint8)
        out = np.zeros(len(self.start), bool)
        at = np.flatnonzero(self.key_end - self.key_start == len(want))
        at = at[self.key_start[at] >= 0]
        if len(at):
            out[at] = (self._buf[self.key_start[at][:, None] + np.arange(len(want))] == want).all(axis=1)
        odd = np.flatnonzero((self.key_start >= 0) & (self._slash[np.maximum(self.key_end, 0)] > self._slash[np.maximum(self.key_start, 0)]))
        for i in odd:  # names written with escapes
            out[i] = json.loads(self.data[self.key_start[i] - 1 : self.key_end[i] + 1]) == name
        # Of members that repeat a name, the last counts.
        hit = np.flatnonzero(out)
        if len(hit):
            latest: dict[int, int] = {}
            dup = np.flatnonzero(self.parent[hit][1:] == self.parent[hit][:-1])
            if len(dup) or len(np.unique(self.parent[hit])) < len(hit):
                for i in hit:
                    latest[int(self.parent[i])] = int(i)
                out[:] = False
                out[list(latest.values())] = True
        return out

    def is_null(self, nodes: np.ndarray) -> np.ndarray:
        return (self.kind[nodes] == SCALAR) & (self._buf[self.start[nodes]] == 0x6E)

    def text(self, i: int) -> str:
        """The value of a string node, or the JSON text of another."""
        a, b = self.start[i], self.end[i]
        if self.kind[i] == STRING and self._slash[b] > self._slash[a]:
            return json.loads(self.data[a - 1 : b + 1])
        return self.data[a:b].decode("utf-8", "replace")


def _inner(ix: Index, list_names: tuple[str, ...]) -> dict[int, list[tuple[int, int, bytes]]]:
    """By text the spans of whole values, and of lists under ``list_names``, that are held as JSON texts, and these texts."""
    at = np.zeros(len(ix.start), bool)
    for name in list_names:
        at |= ix.named(name)
    at |= ix.parent < 0
    at &= ix.kind == STRING
    inner = [(i, ix.text(i).strip().encode("utf-8", "replace")) for i in np.flatnonzero(at)]
    inner = [(i, t) for i, t in inner if t[:1] == b"[" or (t[:1] in (b"{", b'"') and ix.parent[i] < 0)]
    good = Index([t for _, t in inner]).valid if inner else []
    splices: dict[int, list[tuple[int, int, bytes]]] = {}
    for (i, t), v in zip(inner, good):
        if v:
            splices.setdefault(int(ix.doc[i]), []).append((int(ix.start[i]) - 1, int(ix.end[i]) + 1, t))
    return splices


def _spliced(ix: Index, d: int, cuts: list[tuple[int, int, bytes]]) -> bytes:
    """Text ``d`` with the given spans written out."""
    a = int(ix.start[ix.root[d]]) - (ix.kind[ix.root[d]] == STRING)
    b = int(ix.end[ix.root[d]]) + (ix.kind[ix.root[d]] == STRING)
    parts, here = [], a
    for x, y, t in sorted(cuts):
        parts += [ix.data[here:x], t]
        here = y
    return b"".join([*parts, ix.data[here:b]])


def indexed(texts: list[bytes], list_names: tuple[str, ...]) -> list[tuple[Index, np.ndarray]]:
    """Indexes that together hold all texts, each with the numbers of its texts, with texts within texts written out.

    Only texts that hold others are indexed again, until none does, however often one is wrapped: each round makes
    the texts it changes shorter. A text is left to the index in which nothing in it is wrapped; in the ones before
    it is marked as having no root.
    """
    out, numbers = [], np.arange(len(texts))
    while len(numbers):
        ix = Index(texts)
        splices = _inner(ix, list_names)
        again = sorted(splices)
        texts = [_spliced(ix, d, splices[d]) for d in again]
        ix.root[again] = -1
        out.append((ix, numbers))
        numbers = numbers[again]
    return out


def unwrapped(texts: list[bytes], list_names: tuple[str, ...]) -> list[bytes]:
    """Texts in which whole values, and lists under ``list_names``, held as JSON texts are written out."""
    texts, todo = list(texts), list(range(len(texts)))
    while todo:
        ix = Index([texts[i] for i in todo])
        splices = _inner(ix, list_names)
        for d, cuts in splices.items():
            texts[todo[d]] = _spliced(ix, d, cuts)
        todo = [todo[d] for d in splices]
    return texts
