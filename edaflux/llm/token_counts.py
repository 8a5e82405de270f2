"""Exact sentencepiece token counts from a compiled finite-state transducer.

Byte-pair encoding of a prefix is a prefix of the encoding up to its last piece: the last piece ``t`` of a prefix is the
one suffix that is a piece and whose pair with the last piece before it re-encodes to just that pair. So a state needs
only the longest suffix that begins some piece and, at each of its positions from which a piece can still grow, the last
piece and the count relative to the end. That is a deterministic transducer; each transition is annotated with the number of tokens by which the count
changes (it may be negative, when a character joins pieces). States are interned and transitions compiled when text
first asks for them.

No piece spans the start of a word (a space mark after another character), so a word start maps every state to one
state. A text is cut into chunks, and each has a map from entry to exit states with counts. All chunks of a slice run side
by side from their first word start, from where their map is constant. What lies before it, or the whole of a chunk without
a word start, is tabulated for the states that may enter: the exit of a constant map before it, or a guess (the state
reached over the last characters of the chunk before), and then every exit of the chunk before that is not in the table
yet, until there is none. Two states soon meet on most texts, so a map has few rows. A parallel prefix scan composes the
maps, over distances that double, to the state that enters each chunk; the counts are read from the maps at those states.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edaflux.llm.frames import map_rows

SPACE = "▁"
CHUNK = 512
_WORD = np.uint32(0x110000)  # stands for a space mark at the start of a word; above every code point
_CODE_BITS = 21
_SLOT_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
MAX_STATES = 300_000
NARROW = 24
WARM = 48  # characters before a chunk from which the state that enters it is guessed
TRIED = 16  # rows of a chunk's map, on average, from which on no states are tried
_ROW = 32  # a row of the maps is chunk << 32 | entry state


class Transducer:
    """The compiled tokenizer of one sentencepiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.score = {}
        for i in range(sp.get_piece_size()):
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)):
                self.score[sp.id_to_piece(i)] = sp.get_score(i)
        if not sp.is_byte(sp.piece_to_id("<0x00>")):
            raise ValueError("the model has no byte fallback")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece spans a word start; words can't be counted one by one")
        self.open = {p[:k] for p in self.score for k in range(len(p))}  # what a further character can extend
        self.prefixes = self.open | set(self.score)
        self.pair = lru_cache(1 << 17)(self._pair)
        self.clear()

    def clear(self) -> None:
        self.states = [("", (None,), (0,))]
        self.ids = {self.states[0]: 0}
        self.memo: dict[int, int] = {}
        self.keys = np.full(1 << _SLOT_BITS, np.iinfo(np.uint64).max, np.uint64)
        self.vals = np.zeros(1 << _SLOT_BITS, np.int64)
        self.pair.cache_clear()

    def encode(self, text: str) -> list[str]:
        """Merge the adjacent pair whose join scores best, leftmost first, until no join is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, left: str | None, right: str) -> bool:
        return self.encode(right) == [right] if left is None else self.encode(left + right) == [left, right]

    def compile(self, key: int) -> int:
        """The transition of (state, character): next state and change of the count, packed."""
        found = self.memo.get(key)
        if found is not None:
            return found
        if key == int(_WORD):
            state, char = 0, SPACE
        else:
            state, char = key >> _CODE_BITS, chr(key & ((1 << _CODE_BITS) - 1))
        suffix, lasts, counts = self.states[state]
        if char not in self.score:  # byte fallback: a token for each byte, and nothing joins across it
            target, change = self.states[0], len(char.encode("utf-8", "surrogatepass"))
        else:
            after, drop = suffix + char, 0
            while after not in self.prefixes:
                after, drop = after[1:], drop + 1
            for k in range(len(after)):
                piece = after[k:]
                if piece in self.score and self.pair(lasts[drop + k], piece):
                    change = counts[drop + k] + 1
                    break
            else:
                raise AssertionError(f"no last piece for {after!r}")
            lasts, counts = (*lasts[drop:], piece), (*(c - change for c in counts[drop:]), 0)
            cut = next(k for k in range(len(after) + 1) if after[k:] in self.open)
            live = [after[k:] in self.open for k in range(cut, len(after) + 1)]  # no piece grows from the others
            target = (
                after[cut:], tuple(p if on else "" for p, on in zip(lasts[cut:], live, strict=True)),
                tuple(c if on else 0 for c, on in zip(counts[cut:], live, strict=True)),
            )
        to = self.ids.setdefault(target, len(self.states))
        if to == len(self.states):
            self.states.append(target)
        self.memo[key] = found = (to << 8) | (change + 128)
        return found

    def step(self, key: np.ndarray) -> np.ndarray:
        slot = ((key * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        value = self.vals[slot]
        miss = np.flatnonzero(self.keys[slot] != key)
        if miss.size:
            fresh, back = np.unique(key[miss], return_inverse=True)
            made = np.fromiter((self.compile(int(k)) for k in fresh), np.int64, fresh.size)
            value[miss] = made[back]
            where = ((fresh * _MIX) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
            self.keys[where], self.vals[where] = fresh, made  # of two keys in one slot the last stays, in both arrays
        return value

    def run(self, codes: np.ndarray, start: np.ndarray, length: np.ndarray, state: np.ndarray):
        """Counts and exit states of chunks side by side, one character of each at a time."""
        order = np.argsort(-length, kind="stable")
        at, n = start[order], length[order]
        now, count = state[order].astype(np.uint64), np.zeros(len(order), np.int64)
        active = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")
        for t, k in enumerate(active):
            if k <= NARROW:  # few chunks left: plain loops are quicker than short arrays
                for i in range(k):
                    s, c = int(now[i]), 0
                    for x in codes[at[i] + t : at[i] + n[i]].tolist():
                        v = self.compile(x if x == 0x110000 else s << _CODE_BITS | x)
                        s, c = v >> 8, c + (v & 255) - 128
                    now[i], count[i] = s, count[i] + c
                break
            c = codes[at[:k] + t].astype(np.uint64)
            v = self.step(np.where(c == _WORD, np.uint64(_WORD), (now[:k] << np.uint64(_CODE_BITS)) | c))
            now[:k] = (v >> 8).astype(np.uint64)
            count[:k] += (v & 255) - 128
        counts, states = np.empty_like(count), np.empty(len(order), np.int64)
        counts[order], states[order] = count, now.astype(np.int64)
        return counts, states

    def tabulate(self, codes, start, sync, head, constant, exit_state) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The maps of the chunks ``head`` before their first word starts: rows in order, exit states, counts.

        Every exit of a chunk without a word start has its row in the map of the next chunk. States that don't meet, as on
        a periodic text, whose few states tell its phases apart, are tried further on as well, over distances that double,
        where the same characters come before; beyond ``TRIED`` rows a chunk only the exits themselves are.
        """
        reads = np.zeros(len(start) + 1, bool)
        reads[head] = True
        entry = exit_state[head - 1].copy()
        blind = ~constant[head - 1]
        # A chunk without a word start is a whole one, so that much lies between its start and the next one's.
        warm = np.full(int(blind.sum()), min(WARM, CHUNK), np.int64)
        entry[blind] = self.run(codes, start[head[blind]] - warm, warm, np.zeros(len(warm), np.int64))[1]
        rows, exits, counts = (np.zeros(0, np.int64) for _ in range(3))
        new, ahead = head << _ROW | entry, 1
        ends = np.append(np.flatnonzero(~reads[1:-1] | constant[:-1]) + 1, len(start))  # chunks no open one leads into
        before = np.zeros(len(start), np.int64)
        for k in range(1, 17):
            before = before * 1_000_003 + codes[np.maximum(start - k, 0)]
        while new.size:
            if ahead > 4 and rows.size < TRIED * head.size:
                chunk = new >> _ROW
                n = np.minimum(ends[np.searchsorted(ends, chunk, side="right")] - chunk, ahead)
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                alike = before[np.repeat(chunk, n)] == before[np.repeat(chunk, n) + step]
                new = np.setdiff1d((np.repeat(new, n) + (step << _ROW))[alike], rows)
            ahead *= 2
            chunk = new >> _ROW
            count, state = self.run(codes, start[chunk], (sync - start)[chunk], new & ((1 << _ROW) - 1))
            rows, exits, counts = np.append(rows, new), np.append(exits, state), np.append(counts, count)
            order = np.argsort(rows)
            rows, exits, counts = rows[order], exits[order], counts[order]
            on = ~constant[chunk] & reads[chunk + 1]
            new = np.setdiff1d(chunk[on] + 1 << _ROW | state[on], rows)
        return rows, exits, counts

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        out = np.zeros(len(texts), np.int64)
        full = [i for i, t in enumerate(texts) if t]
        if not full:
            return out
        if len(self.states) > MAX_STATES:
            self.clear()
        marked = [SPACE + texts[i].replace(" ", SPACE) for i in full]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        text_at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        space = codes == ord(SPACE)
        word = space & ~np.concatenate([[False], space[:-1]])
        word[text_at] = True
        codes[word] = _WORD
        chunks = -(-sizes // CHUNK)
        first = np.concatenate([[0], np.cumsum(chunks)[:-1]])
        start = np.repeat(text_at, chunks) + CHUNK * (np.arange(chunks.sum()) - np.repeat(first, chunks))
        end = np.minimum(start + CHUNK, np.repeat(text_at + sizes, chunks))
        words = np.flatnonzero(word)
        nearest = np.append(words, len(codes))[np.searchsorted(words, start)]
        constant, sync = nearest < end, np.minimum(nearest, end)
        total, exit_state = np.zeros(len(start), np.int64), np.full(len(start), -1, np.int64)
        has = np.flatnonzero(constant)
        total[has], exit_state[has] = self.run(codes, sync[has], (end - sync)[has], np.zeros(len(has), np.int64))
        head = np.flatnonzero(sync > start)
        if head.size:
            rows, exits, counts = self.tabulate(codes, start, sync, head, constant, exit_state)
            compose(rows, exits, constant, exit_state)
            total[head] += counts[np.searchsorted(rows, head << _ROW | exit_state[head - 1])]
        out[full] = np.add.reduceat(total, first)
        return out


def compose(rows: np.ndarray, exits: np.ndarray, constant: np.ndarray, exit_state: np.ndarray) -> None:
    """Fill in the exit states of the chunks without a word start by a prefix scan over their maps.

    After the step of distance d a map reads the state that enters the chunk 2d - 1 places before its own, or the first of
    its run if that is nearer, and gives the exit of its own.
    """
    open_ended = np.flatnonzero(~constant)
    if not open_ended.size:
        return
    # A text's first chunk begins with a word, so each run has a constant map before it.
    place = np.arange(len(constant))
    depth = place - np.maximum.accumulate(np.where(constant, place, -1))  # 1 for the first chunk of a run
    own = ~constant[rows >> _ROW]
    rows, exits = rows[own], exits[own]
    distance = 1
    while distance < depth.max():
        chunk = rows >> _ROW
        to = np.minimum(chunk + distance, len(constant) - 1)
        feeds = depth[to] == depth[chunk] + distance
        to = to[feeds]
        through = exits[np.searchsorted(rows, to << _ROW | exits[feeds])]
        whole = depth[chunk] <= distance  # these have met the beginning of their run
        rows, exits = np.append(rows[whole], to << _ROW | rows[feeds] & ((1 << _ROW) - 1)), np.append(exits[whole], through)
        order = np.argsort(rows)
        rows, exits, distance = rows[order], exits[order], 2 * distance
    first = open_ended - depth[open_ended]
    exit_state[open_ended] = exits[np.searchsorted(rows, open_ended << _ROW | exit_state[first])]


@lru_cache(2)
def transducer(model: bytes) -> Transducer:
    return Transducer(model)


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, n_tokens, over_limit): tokens of each whole text, without begin and end tokens.

    One output row for each input row, repeated rows and null keys included; a null text counts as empty, with 0 bytes
    and 0 tokens. Other columns are not read. The model file is read by the driver and sent with the task; what a task
    holds is one slice of texts and at most ``MAX_STATES`` compiled states besides those of the slice.
    """
    with open(model_path, "rb") as f:
        model = f.read()

    def work(rows: dict) -> dict:
        n = transducer(model).count(rows["text"])
        return {"key": rows["key"], "n_bytes": rows["n_bytes"], "n_tokens": n, "over_limit": n > limit}

    picked = docs.select(
        F.col(key).alias("key"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text).alias("text"),
    )
    kind = docs.schema[key].dataType.simpleString()
    return map_rows(picked, work, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("key", key)
