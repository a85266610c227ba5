"""Token counts by a transducer whose transitions carry emitted-token counts, over chunks whose state maps compose."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces


class State(dict):
    """One state: character -> (next state, tokens emitted), filled as characters are met.

    ``word`` is the longest end of the text read that begins a longer piece. ``live`` has, for each such end and last for
    the empty one, its length, the last token before it (None where no piece could reach across) and the tokens up to
    there, less the fewest of all. ``due`` is what is still to be emitted if the text ends here.
    """

    __slots__ = ("machine", "key", "word", "live", "due")

    def __init__(self, machine: CountTransducer, key: tuple):
        self.machine, self.key, (self.word, self.live) = machine, key, key
        self.due = self.live[-1][2]

    def __missing__(self, char: str) -> tuple[State, int]:
        found = self[char] = self.machine.step(self, char)
        return found

    def dump(self) -> str:
        return json.dumps(self.key, ensure_ascii=False)


@dataclass
class StateMap:
    """What a chunk does to the state.

    Closed: from any state it emits what ``head`` emits from there, then ``body``, and ends in state ``tail``. Open (tail
    is None): it emits what ``head``, the whole chunk, emits.
    """

    head: str
    body: int = 0
    tail: str | None = None


class CountTransducer:
    """Deterministic transducer over the characters of a text for a sentencepiece BPE model; outputs are numbers of tokens.

    A sequence of pieces is what the model gives for their text if it is so for each two neighbours. So the last token of
    every prefix follows from the last tokens of shorter ones: it is the longest piece ending there that goes with the last
    token before it. A state keeps these for the places where a piece may still begin, which are fewer than the longest
    piece has characters; so states are finitely many. They are compiled as they are met; beyond ``most`` the table starts afresh.
    """

    def __init__(self, path: str, most: int = 200_000, words: int = 500_000):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [(i, m.id_to_piece(i)) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.before = m.encode("\n")
        own = m.encode(["\n" + p for _, p in plain])
        if "".join(m.encode("a  b ", out_type=str)) != "▁a▁▁b▁" or any("\n" in p for _, p in plain) or not any(map(m.is_byte, self.before)):
            raise ValueError("this model changes white space, has pieces across lines or no bytes for other characters")
        self.pieces = {p: i for (i, p), ids in zip(plain, own) if ids == [*self.before, i]}
        self.begins = {p[:k] for p in self.pieces for k in range(1, len(p))}
        self.chars = {c for p in self.pieces for c in p}
        self.joins = {p[k : k + 2] for p in self.pieces for k in range(len(p) - 1)}
        self.longest, self.most = max(map(len, self.pieces)), most
        self.agree: dict[tuple[str, str], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state("", ((0, None, 0),))
        self.space, self.words, self.most_words = self.step(self.start, "▁")[0], {}, words

    def state(self, word: str, live: tuple) -> State:
        key = word, live
        found = self.states.get(key)
        if found is None:
            if len(self.states) >= self.most:
                for s in self.states.values():
                    s.clear()
                self.states, self.agree = {}, {}
            found = self.states[key] = State(self, key)
        return found

    def goes(self, a: str | None, b: str) -> bool:
        """Whether the model leaves pieces a and b as they are, side by side."""
        if a is None or a[-1] + b[0] not in self.joins:
            return True
        found = self.agree.get((a, b))
        if found is None:
            found = self.agree[a, b] = self.model.encode("\n" + a + b) == [*self.before, self.pieces[a], self.pieces[b]]
        return found

    def step(self, state: State, char: str) -> tuple[State, int]:
        if char not in self.chars:  # its bytes, each a token
            return self.start, state.due + len(char.encode())
        kept, ended, across = [], None, False
        for size, last, n in state.live:
            end = state.word[len(state.word) - size :] + char
            longer, piece = end in self.begins, end in self.pieces
            across = across or (size > 0 and (longer or piece))
            last = last if size or across else None
            if piece and ended is None and self.goes(last, end):
                ended = (end, n + 1)
            if longer:
                kept.append((size + 1, last, n))
        kept.append((0, *ended))
        least = min(n for _, _, n in kept)
        word = (state.word + char)[-kept[0][0] :] if kept[0][0] else ""
        return self.state(word, tuple((size, last, n - least) for size, last, n in kept)), least

    def walk(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            state, n = state[char]
            total += n
        return state, total

    def run(self, state: State, text: str) -> tuple[State, int]:
        """Where a text leads and what it emits. Ways from the state after a space over a word and back to it are one transition."""
        if len(self.words) > self.most_words:
            self.words = {}
        total, space, known = 0, self.space.key, self.words
        *parts, rest = text.split("▁")
        for word in parts:
            n = known.get(word) if state.key == space else None
            if n is None:
                there, n = self.walk(state, word + "▁")
                if there.key == state.key == space and len(word) <= 60:
                    known[word] = n
                state = there
            total += n
        state, n = self.walk(state, rest)
        return state, total + n

    def load(self, dumped: str) -> State:
        word, live = json.loads(dumped)
        return self.state(word, tuple(map(tuple, live)))

    def meeting(self, text: str) -> tuple[int, State] | None:
        """The first place of a chunk where the state is the same whatever came before, with that state.

        A token that reaches into the chunk ends among its first ``longest`` characters, so a run started after each of
        these stands for all that may have come before. Where all runs give a prefix the same last token, that token is
        known. The state is known once every live place leads back over known tokens to one place common to all, or
        to a place that no piece can reach across.
        """
        runs, known = {}, {}
        for at, char in enumerate(text):
            if at < self.longest:
                runs[self.start.key] = self.start
            runs = {s.key: s for s in (r[char][0] for r in runs.values())}
            ends = {s.live[-1][1] for s in runs.values()}
            here = at + 1
            if here >= self.longest and len(ends) == 1:
                known[here] = len(ends.pop() or char)
            if len(runs) > 1 or here < 2 * self.longest:
                continue
            state = next(iter(runs.values()))
            size, last, _ = state.live[0]
            if last is None and here - size >= self.longest:
                return here, state
            chains = []
            for size, _, _ in state.live:
                place, chain = here - size, set()
                if place in known:
                    chain.add(place)
                while place in known:
                    place -= known[place]
                    chain.add(place)
                chains.append(chain)
            if set.intersection(*chains):
                return here, state
        return None

    def map_of(self, chunk: str, first: bool) -> StateMap:
        """State map of a chunk; the first of a text begins in the start state, with the library's leading space."""
        text = chunk.replace(" ", "▁")
        if first:
            state, n = self.run(self.start, "▁" + text if text else "")
            return StateMap("", n, state.dump())
        found = self.meeting(text)
        if not found:
            return StateMap(text)
        state, n = self.run(found[1], text[found[0] :])
        return StateMap(text[: found[0]], n, state.dump())

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        if a.tail is None:
            return StateMap(a.head + b.head, b.body, b.tail)
        state, n = self.run(self.load(a.tail), b.head)
        return StateMap(a.head, a.body + n + b.body, state.dump() if b.tail is None else b.tail)

    def total(self, maps: list[StateMap]) -> int:
        """Tokens of a whole text: neighbours are composed pairwise, level by level, until one map is left, which ends the text."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0].body + self.load(maps[0].tail).due


@lru_cache(maxsize=4)
def transducer(path: str) -> CountTransducer:
    return CountTransducer(path)


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096,
                 chunk_chars: int = 1 << 16) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, n_chunks of every row.

    Texts of any length are cut into chunks of ``chunk_chars``; each chunk's state map is made by the task that reads it, and only
    maps are shuffled, by row, and composed: at most 32,768 a row, as a string has at most 2 GB. A map is a few dozen characters
    unless no place of the chunk has a known state (one character over and over); then it is the chunk, and the count stays right.
    A null or empty text has 0 tokens; special strings inside a text are ordinary text; repeated rows are counted each; null ids
    are kept; other columns are not read, whatever their names; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / chunk_chars))
    cuts = F.when(F.length("text") <= chunk_chars, F.array("text")).otherwise(
        F.transform(starts, lambda i: F.substring("text", (i * chunk_chars + 1).cast("int"), F.lit(chunk_chars))))
    chunks = rows.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.posexplode(cuts).alias("pos", "chunk"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in pieces(batches):
            got = [machine.map_of(c.as_py(), p.as_py() == 0) for p, c in zip(b.column(3), b.column(4))]
            fields = [pa.array([m.head for m in got], pa.string()), pa.array([m.body for m in got], pa.int64()), pa.array([m.tail for m in got], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *fields], ["row", "doc_id", "n_bytes", "pos", "head", "body", "tail"])

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model)
        for b in pieces(batches):
            n = [machine.total([StateMap(m["head"], m["body"], m["tail"]) for m in sorted(ms, key=lambda m: m["pos"])]) for ms in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), b.column(3)], ["doc_id", "n_bytes", "n_tokens", "n_chunks"])

    mapped = chunks.mapInArrow(maps, f"row long, doc_id {kind}, n_bytes long, pos int, head string, body long, tail string")
    grouped = mapped.groupBy("row", "doc_id", "n_bytes").agg(F.collect_list(F.struct("pos", "head", "body", "tail")).alias("maps"))
    grouped = grouped.select("doc_id", "n_bytes", "maps", F.size("maps").cast("long").alias("n_chunks"))
    done = grouped.mapInArrow(totals, f"doc_id {kind}, n_bytes long, n_tokens long, n_chunks long")
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks")
