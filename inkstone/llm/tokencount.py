"""Token counts from a tokenizer compiled to a finite-state transducer.

A sentencepiece BPE model is compiled, as far as the texts need it, into a deterministic transducer over characters. Its
transitions carry the number of tokens emitted (negative where a character joins tokens that stood apart). The state after
a prefix is what later characters can depend on: for each ending of the prefix that some piece may still continue, the
token before that ending and its token count. A token may follow another exactly if the model splits the two of them, taken
alone, into these two; so the next state is found from pair checks, which the compiler makes by running the merges on the
pair. No piece holds a space after another character, so a space after a non-space puts the transducer in one known state
whatever came before.

Texts are cut into chunks of ``CHUNK`` characters, most into one. A chunk's *state map* takes an entry state to the exit state
and the tokens emitted in between; a state is written as the endings that it stands for, so that any task can enter it. Maps
are tabulated where they are needed: the first chunk's at the start state, any other's at the state that a run over the
``WARM`` characters before it ends in, which is nearly always the right one, whatever the run began in. Then, in rounds, exit
states that the next chunk's map lacks are looked up there. A chunk with a space after another character has one exit state
whatever it is entered in, so only in a run of chunks without one can a lacking state lead to others: it is looked up in the
whole rest of its run at once. So rounds are no more than the distinct states of a run, however many chunks it has: none for
most texts, and for a text that repeats a few letters without end the phases of the pieces in them. Then the maps of a text
compose in pairs: half as many maps of twice as many chunks, until one is left, after a number of joins that grows with the
logarithm of the chunks. What meets by text are states and counts of two neighbours, never characters.

Defined cases: null counts as the empty text, which has no tokens; special strings are ordinary text; repeated rows each
count; an empty table gives an empty result; only the id and text columns are read. A model that changes characters before
it splits them is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.scratch import Scratch

SPACE = "▁"
CHUNK = 1 << 16
#: Characters before a chunk that a run goes over to find the state at its beginning.
WARM = 256
#: States that a worker keeps between texts; beyond, the compiled part is forgotten and built anew.
MAX_STATES = 300_000
KNOWN = re.compile(f"[^{SPACE}]{SPACE}")
MAP = "struct<entry:string,n:long,exit:string>"
_MAP = pa.struct([("entry", pa.string()), ("n", pa.int64()), ("exit", pa.string())])
#: Texts that a model must leave as they are: compatibility forms, wide spaces, runs of spaces.
PROBES = ["\ufb01 \uff21 \u2460 e\u0301", "a \u3000b\u00a0c", "  a   b  ", "\u200bx\u00ad"]


class Merges:
    """The model's merges on short strings: the best-scored adjacent pair that forms a piece, leftmost first among equals."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in ids}
        if any(KNOWN.search(p) for p in self.score):
            raise ValueError("pieces that run on after a space are not supported")
        self.byte_fallback = any(sp.is_byte(i) for i in range(sp.vocab_size()))
        for text in PROBES:
            if "".join(sp.id_to_piece(i) for i in sp.encode(text) if not sp.is_byte(i) and not sp.is_unknown(i)) != SPACE + "".join(c for c in escape(text) if c in self.score):
                raise ValueError("models that change characters are not supported")
        self.starts = {p[:k]: p[:k] for p in self.score for k in range(1, len(p))}
        self.pieces = {p: p for p in self.score}

    def split(self, text: str) -> list[str]:
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, where = s, i
            if where < 0:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def weight(self, token: str) -> int:
        """Tokens that the library gives for a final symbol."""
        return 1 if token in self.score or not self.byte_fallback else len(token.encode())


class State(dict):
    """Maps a character to the next state; a missing transition is compiled on first use."""

    __slots__ = ("emit", "endings", "machine", "spaced")

    def __missing__(self, char: str) -> State:
        state = self[char] = self.machine.step(self, char)
        return state


class Transducer:
    def __init__(self, merges: Merges):
        self.merges = merges
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple, State] = {}
        self.pairs: dict[tuple[str | None, str], bool] = {}
        self.start = self.state(0, (("", None, 0),), False)
        self.at_space = self.state(1, (("", SPACE, 0), (SPACE, None, -1)), True)

    def state(self, emit: int, endings: tuple, spaced: bool) -> State:
        key = (emit, endings, spaced)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.emit, found.endings, found.machine, found.spaced = emit, endings, self, spaced
        return found

    def follows(self, before: str | None, token: str) -> bool:
        key = (before, token)
        found = self.pairs.get(key)
        if found is None:
            found = self.pairs[key] = self.merges.split(token) == [token] if before is None else self.follows(None, token) and self.merges.split(before + token) == [before, token]
        return found

    def step(self, state: State, char: str) -> State:
        if char == SPACE and not state.spaced and state is not self.start:
            return self.at_space
        pieces, starts = self.merges.pieces, self.merges.starts
        live, last = [], None
        for ending, before, count in state.endings:
            token = ending + char
            if token in starts:
                live.append((starts[token], before, count))
            if last is None and (not ending or token in pieces) and self.follows(before, token):
                last = (pieces.get(token, token), count + self.merges.weight(token))
        token, count = last
        endings = (("", token, 0), *((e, b, n - count) for e, b, n in live))
        return self.state(count, endings, char == SPACE)

    def name(self, state: State) -> str:
        return json.dumps([state.endings, state.spaced], ensure_ascii=False)

    def named(self, name: str) -> State:
        endings, spaced = json.loads(name)
        return self.state(0, tuple((self.merges.starts.get(e, e), b, n) for e, b, n in endings), spaced)

    def run(self, text: str, state: State) -> tuple[int, State]:
        """Tokens emitted and the state after the text."""
        n = 0
        for char in text:
            state = state[char]
            n += state.emit
        return n, state

    def map(self, chunk: str, entry: str) -> tuple[int, str]:
        """Tokens and exit state of a chunk, spaces escaped, for one entry state."""
        if len(self.states) > MAX_STATES:
            self.forget()
        n, state = self.run(chunk, self.named(entry))
        return n, self.name(state)

    def count(self, text: str) -> int:
        """Tokens of a text that starts in the start state."""
        return self.map(text, START)[0]


#: The start state by name.
START = json.dumps([[["", None, 0]], False])


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(Merges(path))


def escape(text: str) -> str:
    return text.replace(" ", SPACE)


def state_maps(chunk: Column, first: Column, lead: Column, entry: Column, path: str) -> Column:
    """The map of each chunk at one entry state: ``entry``, or where that is null the start state for the first chunk of a
    text and else the state after ``lead``. The first chunk of a text that isn't empty has a space before it."""

    @F.arrow_udf(MAP)
    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        machine = transducer(path)
        for batch in batches:
            out = []
            for text, begins, before, at in zip(*(c.to_pylist() for c in batch), strict=True):
                at = at or (START if begins else machine.map(escape(before), START)[1])
                out.append((at, *machine.map((SPACE if begins and text else "") + escape(text), at)))
            yield pa.StructArray.from_arrays([pa.array([x[k] for x in out], _MAP[k].type) for k in range(3)], fields=list(_MAP))
        release()

    return run(chunk, first, lead, entry)


def _cut(chunk: int, warm: int):
    """Rows (id, n_bytes, h, text) to rows of chunks with their positions and the characters before them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text").to_pylist()):
                starts = range(0, len(text), chunk)
                keys = batch.select(["id", "n_bytes", "h"]).slice(i, 1)
                columns = [pa.concat_arrays([c] * len(starts)) for c in keys.columns]
                leads, parts = [text[max(0, k - warm) : k] for k in starts], [text[k : k + chunk] for k in starts]
                ends_run = [bool(KNOWN.search(escape(part))) for part in parts]  # whatever it is entered in, it is left in one state
                runs = [0, *accumulate(map(int, ends_run))][:-1]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int32()) for x in (range(len(starts)), runs)), *(pa.array(x, pa.string()) for x in (leads, parts))], ["id", "n_bytes", "h", "pos", "run", "lead", "chunk"])

    return cut


def _alike(x: str, y: str, *more: str) -> Column:
    """Whether two rows are of one text, and equal in more columns."""
    return reduce(and_, [F.col(f"{x}.{c}") == F.col(f"{y}.{c}") for c in ("h", *more)], F.col(f"{x}.id").eqNullSafe(F.col(f"{y}.id")))


def closed(chunks: DataFrame, path: str, scratch: Scratch) -> DataFrame:
    """(id, h, pos, entry, n, exit): the maps of all chunks, at every entry state that the maps before them lead to."""
    at = ("id", "h", "run", "pos")
    tabulated = lambda rows, entry: rows.select(*at, state_maps(F.col("chunk"), F.col("pos") == 0, F.col("lead"), entry, path).alias("m")).select(*at, "m.*").distinct()
    maps = scratch.keep(tabulated(chunks, F.lit(None).cast("string")), "maps0")
    places = scratch.keep(chunks.select(*at).distinct(), "places")
    fresh, i = maps, 0
    while True:
        i += 1
        after = fresh.select("id", "h", (F.col("pos") + 1).alias("pos"), F.col("exit").alias("entry")).distinct().alias("w").join(places.alias("p"), _alike("w", "p", "pos")).select("w.*", "p.run").alias("w")
        lacking = after.join(maps.alias("t"), _alike("w", "t", "pos") & (F.col("w.entry") == F.col("t.entry")), "left_anti")
        # in the chunk that lacks it, and in all that follow in the same run
        since = lacking.groupBy("id", "h", "run", "entry").agg(F.min("pos").alias("since")).alias("s")
        wanted = places.alias("p").join(since, _alike("p", "s", "run") & (F.col("p.pos") >= F.col("s.since"))).select("p.*", "s.entry").alias("w")
        wanted = wanted.join(maps.alias("t"), _alike("w", "t", "pos") & (F.col("w.entry") == F.col("t.entry")), "left_anti").alias("w")
        texts = chunks.alias("c").join(wanted, _alike("c", "w", "pos")).select(*[f"c.{c}" for c in (*at, "lead", "chunk")], "w.entry")
        fresh = scratch.keep(tabulated(texts, F.col("entry")), f"maps{i}")
        if fresh.isEmpty():
            return maps.drop("run")
        maps = scratch.keep(maps.unionByName(fresh), f"known{i}")


def composed(maps: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, h, n_tokens) of each text: the maps of neighbours are joined into one, over and over."""
    last = maps.groupBy("id", "h").agg(F.max("pos").alias("last"))
    m, t = maps.alias("m"), last.alias("t")
    maps = m.join(t, _alike("m", "t")).select("m.*", "t.last")
    longest, i = last.agg(F.max("last")).first()[0] or 0, 0
    while longest:
        a, b = maps.where("pos % 2 = 0 AND pos < last").alias("a"), maps.where("pos % 2 = 1").withColumn("pos", F.col("pos") - 1).alias("b")
        two = a.join(b, _alike("a", "b", "pos") & (F.col("a.exit") == F.col("b.entry"))).select("a.id", "a.h", "a.pos", "a.entry", (F.col("a.n") + F.col("b.n")).alias("n"), "b.exit", "a.last")
        both = two.unionByName(maps.where("pos % 2 = 0 AND pos = last"))
        maps = scratch.keep(both.withColumns({"pos": (F.col("pos") / 2).cast("int"), "last": F.floor(F.col("last") / 2).cast("int")}), f"composed{i}")
        longest, i = longest // 2, i + 1
    return maps.where(F.col("entry") == START).select("id", "h", F.col("n").alias("n_tokens"))


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, warm: int = WARM) -> DataFrame:
    """One row per document: ``n_bytes`` and ``n_tokens``.

    The map of a text of one chunk is made where the text is read. The chunks of longer texts are dealt out over the cluster.
    """
    modest_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    alone = state_maps(F.col("text"), F.lit(True), F.lit(""), F.lit(START), path)
    short = rows.where(F.char_length("text") <= chunk).select("id", "n_bytes", alone["n"].alias("n_tokens"))
    long = rows.where(F.char_length("text") > chunk).withColumn("h", F.xxhash64("text"))
    id_type = rows.schema["id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "tokencount")
    chunks = long.mapInArrow(_cut(chunk, warm), f"id {id_type}, n_bytes long, h long, pos int, run int, lead string, chunk string")
    chunks = scratch.keep(chunks.repartition("id", "h", "pos"), "chunks")
    # a row that occurs n times has n chunks at position 0, and one set of maps
    texts = chunks.where("pos = 0").groupBy("id", "n_bytes", "h").agg(F.count("*").cast("int").alias("times"))
    t, m = texts.alias("t"), composed(closed(chunks, path, scratch), scratch).alias("m")
    counted = t.join(m, _alike("t", "m")).select("t.id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth"))
    counted = scratch.keep(counted.drop("nth"), "counted")
    scratch.drop_all_but("counted")
    return short.unionByName(counted).withColumnRenamed("id", id_col)
