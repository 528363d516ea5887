"""Conversation structure repair by dynamic programming over a trie of role and fault signatures.

Turns are sorted by a range shuffle and cut, within the sorted partitions, into chunks of a bounded
number of turns and bytes, so a conversation of any length is spread over tasks. Each turn becomes one
letter (its role's initial and its fault), each chunk a short signature. The distinct signatures,
sorted, are inserted into a prefix trie; a layer of the dynamic programme is computed once for each
node, that is once for each shared prefix, and the answer is read off at the terminal nodes: for every
state before the chunk and every state after it the cheapest edits. Conversations then chain the
answers of their chunks in one streaming pass, which also applies the edits to the turns.

States of the repaired roles `(s?(ua)+)?`: 0 nothing yet, 1 after the system turn, 2 after a user, 3
after an assistant; 0 and 3 may end a conversation. A state and an edit determine the next state and
role, so edits are strings of K(eep), R(erole), D(elete) and I(nsert), compared by cost and then as
text. Neither of two cheapest strings that reach one state can begin with the other, since going round
by insertions alone costs something; so keeping the least string of each state is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import Scratch, copied, dealt, hot_keys

#: Visible characters, sentence ends, and what the edits cost.
VISIBLE = r"[^\x20\x09-\x0D]"
ENDS = ".!?"
REROLE, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1

#: Letters of a signature: role initials, in capitals if the text is cut short; b and d have to be deleted.
BLANK, DUPLICATE, OTHER = "b", "d", "o"

START, SYSTEM, USER, ASSISTANT = range(4)
ENDINGS = (START, ASSISTANT)
#: What an inserted or reroled turn leads to.
AFTER = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}

Paths = dict[int, tuple[int, str]]


def struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])



TEXT, LONG = T.StringType(), T.LongType()
CHUNKS = struct(key=TEXT, chunk=LONG, whole=T.BooleanType(), roles=T.ArrayType(TEXT), texts=T.ArrayType(TEXT), letters=TEXT, hashes=T.ArrayType(T.BinaryType()), places=T.ArrayType(T.IntegerType()), low=LONG, high=LONG, turns=LONG, illegal=LONG)
ANSWERS = struct(letters=TEXT, answer=TEXT)
TURNS = struct(key=TEXT, place=LONG, role=TEXT, text=TEXT, edit=TEXT)
AUDITS = struct(key=TEXT, gaps=LONG, blank=LONG, duplicate=LONG, truncated=LONG, illegal=LONG, cost=LONG, audit=TEXT, repaired_sha256=TEXT)


def better(paths: Paths, state: int, cost: int, edits: str) -> None:
    if state not in paths or (cost, edits) < paths[state]:
        paths[state] = (cost, edits)


def with_insertions(paths: Paths) -> Paths:
    """The paths, and those that go on by inserting turns."""
    for state in (START, SYSTEM, ASSISTANT, USER):
        if state in paths:
            better(paths, AFTER[state], paths[state][0] + INSERT, paths[state][1] + "I")
    return paths


def next_layer(layer: Paths, letter: str) -> Paths:
    """The cheapest edits up to one more turn."""
    paths: Paths = {}
    short = CUT_SHORT if letter.isupper() else 0
    for state, (cost, edits) in layer.items():
        better(paths, state, cost + DELETE, edits + "D")
        if letter not in (BLANK, DUPLICATE):
            kept = KEPT.get((state, letter.lower()))
            if kept is not None:
                better(paths, kept, cost + short, edits + "K")
            better(paths, AFTER[state], cost + REROLE + short, edits + "R")
    return with_insertions(paths)


class Trie:
    """A prefix trie of signatures that come sorted: only the nodes on the way to the last one are held."""

    def __init__(self):
        self.path, self.nodes = "", [[with_insertions({state: (0, "")}) for state in range(4)]]
        self.layers = 0

    def insert(self, signature: str) -> list[Paths]:
        """The answers at the terminal node: for every state before the signature, the paths to every state after it."""
        shared = len(commonprefix((self.path, signature)))
        del self.nodes[shared + 1 :]
        for letter in signature[shared:]:
            self.nodes.append([next_layer(layer, letter) for layer in self.nodes[-1]])
            self.layers += 1
        self.path = signature
        return self.nodes[-1]


def written(answer: list[Paths]) -> str:
    return ";".join(",".join(f"{state}{cost}:{edits}" for state, (cost, edits) in sorted(paths.items())) for paths in answer)


def read(answer: str) -> list[Paths]:
    out = []
    for paths in answer.split(";"):
        out.append({int(p[0]): (int(p[1 : (cut := p.index(":"))]), p[cut + 1 :]) for p in paths.split(",")})
    return out


class Chain:
    """The cheapest edits of a conversation, chunk by chunk. What all paths begin with is settled and put aside."""

    def __init__(self):
        self.settled: list[str] = []
        self.paths: Paths = {START: (0, "")}

    def add(self, answer: list[Paths]) -> None:
        paths: Paths = {}
        for before, (cost, edits) in self.paths.items():
            for state, (more, on) in answer[before].items():
                better(paths, state, cost + more, edits + on)
        # going on from `assistant` costs at most a deletion (of a system turn) or an insertion (of a user turn) more than from elsewhere
        limit = paths[ASSISTANT][0] + max(DELETE, INSERT)
        paths = {state: path for state, path in paths.items() if path[0] <= limit}
        same = commonprefix([edits for _, edits in paths.values()])
        self.settled.append(same)
        self.paths = {state: (cost, edits[len(same) :]) for state, (cost, edits) in paths.items()}

    def best(self) -> tuple[int, str]:
        cost, edits = min(self.paths[state] for state in ENDINGS if state in self.paths)
        return cost, "".join(self.settled) + edits


def repaired(edits: str, at: int, state: int, roles: list[str], texts: list[str]) -> Iterator[tuple[str, str | None, str, int, int]]:
    """(edit, role, text, place of the next edit, state) for the turns of a chunk, beginning at edit `at`; deleted turns have no role."""
    turn = 0
    while at < len(edits):
        edit = edits[at]
        if edit != "I" and turn == len(roles):
            return
        at += 1
        if edit == "I":
            state = AFTER[state]
            yield edit, ROLE[state], "", at, state
            continue
        role, text = roles[turn], texts[turn]
        turn += 1
        if edit == "K":
            state = KEPT[state, role[0]]
        elif edit == "R":
            state = AFTER[state]
            role = ROLE[state]
        else:
            role = None
        yield edit, role, text, at, state


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, dropped: the rows after the planted damage of op12; a dropped row stays, marked, so that its conversation does."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), F.pmod(F.crc32(F.concat(told(conv_col), F.lit(":"), told(turn_col)).cast("binary")), F.lit(20)).alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") == 0).alias("dropped"), copies.alias("_copy")).drop("_copy")


def signed(rows: DataFrame, conv: str) -> DataFrame:
    """key, turn, role, text, letter, hash, row: the letter is null for a dropped row."""
    last = F.regexp_extract("text", rf"(?s)({VISIBLE})[\x20\x09-\x0D]*\z", 1)
    first = F.substring("role", 1, 1)
    initial = F.when(first.isin("s", "u", "a"), first).otherwise(OTHER)
    letter = F.when(last == "", BLANK).when(last.isin(*ENDS), initial).otherwise(F.upper(initial))
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key"), "turn", "role", "text",
        F.when(~F.col("dropped"), letter).alias("letter"),
        F.unhex(F.substring(F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256), 1, 32)).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )


class Chunker:
    """Cuts sorted turns into chunks; a chunk knows of the duplicates inside it."""

    def __init__(self, first: int, most: int, most_bytes: int):
        self.number, self.most, self.most_bytes = first, most, most_bytes
        self.key, self.out, self.size = None, [], 0
        self.start()

    def start(self) -> None:
        self.roles, self.texts, self.letters, self.new = [], [], [], {}
        self.turns: list[int] = []
        self.illegal = self.bytes = 0

    def add(self, key: str, turn: int | None, role: str, text: str, letter: str | None, hashed: bytes) -> None:
        if key != self.key:
            self.end()
            self.key, self.cut = key, False
        elif letter is not None and (len(self.roles) >= self.most or self.bytes > self.most_bytes):
            self.close(False)
        if letter is None:
            return
        if self.roles and (self.roles[-1][:1] + role[:1]) not in ("su", "ua", "au"):
            self.illegal += 1
        if letter != BLANK and hashed in self.new:
            letter = DUPLICATE
        elif letter != BLANK:
            self.new[hashed] = len(self.roles)
        self.roles.append(role)
        self.texts.append(text)
        self.letters.append(letter)
        self.bytes += len(text) + len(role)
        if turn is not None and (not self.turns or turn != self.turns[-1]):
            self.turns.append(turn)

    def close(self, whole: bool) -> None:
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        hashes = {} if whole else self.new
        self.out.append((self.key, self.number, whole, self.roles, self.texts, "".join(self.letters), list(hashes), list(hashes.values()), low, high, len(self.turns), self.illegal))
        self.size += self.bytes
        self.number += 1
        self.cut = True
        self.start()

    def end(self, sure: bool = True) -> None:
        """The conversation ends; it is whole if it surely lies in this one chunk."""
        if self.key is not None:
            self.close(sure and not self.cut and self.seen)
            self.seen = True

    #: False while the first conversation of the partition, which may have begun in the one before, is read.
    seen = False

    def taken(self) -> pa.RecordBatch:
        schema = to_arrow_schema(CHUNKS)
        batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.out, strict=True), schema, strict=True)], schema=schema)
        self.out, self.size = [], 0
        return batch


def chunks_of(rows: DataFrame, most: int, most_bytes: int) -> DataFrame:
    """CHUNKS, numbered in the order of conversations and turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunker = Chunker(TaskContext.get().partitionId() << 40, most, most_bytes)
        for batch in batches:
            columns = [batch.column(name) for name in ("key", "turn", "role", "text", "letter", "hash")]
            for row in zip(*columns, strict=True):
                chunker.add(*(v.as_py() for v in row))
                if len(chunker.out) >= 2048 or chunker.size > 8 << 20:
                    yield chunker.taken()
        chunker.end(False)
        if chunker.out:
            yield chunker.taken()

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("hash"), F.col("row")]
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, CHUNKS)


def signatures(chunks: DataFrame) -> DataFrame:
    """key, chunk, letters: the letters of every chunk, with duplicates of turns of earlier chunks."""
    met = chunks.where("not whole").select("key", "chunk", F.explode(F.arrays_zip("hashes", "places")).alias("h")).select("key", "chunk", F.col("h.hashes").alias("hash"), F.col("h.places").alias("place"))
    first = met.groupBy("key", "hash").agg(F.min("chunk").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    # one row for a text and chunk at most; Spark splits what is left of a text that a long conversation repeats
    again = met.join(first.hint("merge"), ["key", "hash"]).where("chunk > first").groupBy("chunk").agg(F.collect_list("place").alias("_again"))
    narrow = chunks.select("key", "chunk", "letters").join(again.hint("merge"), "chunk", "left")
    marked = F.expr(f"aggregate(coalesce(_again, array()), letters, (s, p) -> overlay(s placing '{DUPLICATE}' from p + 1 for 1))")
    return narrow.select("key", "chunk", marked.alias("letters"))


def answers(letters: DataFrame) -> DataFrame:
    """ANSWERS: one row for each distinct signature; sorted ranges of signatures share the layers of their prefixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie()
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo in range(0, len(names), 500):
                part = names[lo : lo + 500]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([written(trie.insert(s)) for s in part], pa.string())], names=["letters", "answer"])

    parts = int(letters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return letters.select("letters").distinct().repartitionByRange(parts, "letters").sortWithinPartitions("letters").mapInArrow(run, ANSWERS)


def conversations(rows: DataFrame, write: Callable[[str, Iterator], Iterator], schema: T.StructType, most: int, most_bytes: int, conv_col: str) -> DataFrame:
    """Chain every conversation and hand it to `write`, which turns it into rows of `schema`.

    `write` gets the key and an iterator of one ("sums", values) and then the edited turns in order.
    All rows of a conversation meet in one task, one row a chunk; they stream through it, and what is
    held is one letter a turn.
    """
    scratch = Scratch(rows.sparkSession, "conversations")
    chunks = scratch.keep(chunks_of(signed(rows, conv_col), most, most_bytes), "chunks")
    letters = scratch.keep(signatures(chunks), "letters")
    sizes = letters.groupBy("letters").agg(F.count(F.lit(1)).alias("n"))
    hot = scratch.keep(hot_keys(sizes, "letters", "n", letters.count()), "hot")
    known = copied(scratch.keep(answers(sizes), "answers"), hot, "letters")
    answered = dealt(letters, hot, "letters", "key", "chunk").join(known.hint("merge"), ["letters", "_s"]).select("key", "chunk", "letters", "answer")

    # one pass over (answers of the chunks, then their turns) of each conversation
    sums = chunks.select("chunk", "low", "high", "turns", "illegal", F.get("roles", F.lit(0)).alias("begins"), F.get("roles", F.size("roles") - 1).alias("ends"))
    none = lambda kind: F.lit(None).cast(kind)
    first = answered.join(sums.hint("merge"), "chunk").select("key", F.lit(0).alias("part"), "chunk", "letters", "answer", "low", "high", "turns", "illegal", F.substring("begins", 1, 1).alias("begins"), F.substring("ends", 1, 1).alias("ends"), none("array<string>").alias("roles"), none("array<string>").alias("texts"))
    second = chunks.select("key", F.lit(1).alias("part"), "chunk", none("string").alias("letters"), none("string").alias("answer"), none("bigint").alias("low"), none("bigint").alias("high"), none("bigint").alias("turns"), none("bigint").alias("illegal"), none("string").alias("begins"), none("string").alias("ends"), "roles", "texts")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = stream(batches)
        row = next(source, None)
        kept: list[tuple] = []
        size = 0
        while row is not None:
            key, chain, total = row["key"], Chain(), Sums()
            while row is not None and row["key"] == key and not row["part"]:
                chain.add(read(row["answer"]))
                total.add(row)
                row = next(source, None)
            cost, edits = chain.best()

            def turns() -> Iterator[tuple]:
                nonlocal row
                yield "sums", total.values(cost, edits)
                at, state = 0, START
                while row is not None and row["key"] == key:
                    roles, texts = row["roles"], row["texts"]
                    row = next(source, None)
                    for edit, role, text, at, state in repaired(edits, at, state, roles, texts):  # noqa: B007
                        yield edit, role, text

            for out in write(key, turns()):
                kept.append(out)
                size += sum(len(v) for v in out if isinstance(v, str))
                if len(kept) >= 5000 or size > 8 << 20:
                    yield table(kept)
                    kept, size = [], 0
        if kept:
            yield table(kept)

    def table(kept: list[tuple]) -> pa.RecordBatch:
        arrow = to_arrow_schema(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*kept, strict=True), arrow, strict=True)], schema=arrow)

    return first.unionByName(second).repartition("key").sortWithinPartitions("key", "part", "chunk").mapInArrow(run, schema)


class Sums:
    """Counts of a conversation from those of its chunks, which come in order."""

    def __init__(self):
        self.low = self.high = None
        self.turns = self.illegal = self.blank = self.duplicate = self.truncated = 0
        self.ends: str | None = None

    def add(self, row: dict) -> None:
        if row["low"] is not None:
            self.low = row["low"] if self.low is None else self.low
            self.turns += row["turns"] - (self.high == row["low"])
            self.high = row["high"]
        if row["begins"] is not None:
            self.illegal += row["illegal"] + (self.ends is not None and self.ends + row["begins"] not in ("su", "ua", "au"))
            self.ends = row["ends"]
        letters = row["letters"]
        blank, duplicate = letters.count(BLANK), letters.count(DUPLICATE)
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += sum(map(str.isupper, letters))

    def values(self, cost: int, edits: str) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, edits


def _audit(key: str, turns: Iterator) -> Iterator[tuple]:
    _, sums = next(turns)
    digest, first = hashlib.sha256(), True
    for _, role, text in turns:
        if role is not None:
            digest.update((("" if first else "\n") + f"{role}:{text}").encode())
            first = False
    yield key, *sums, digest.hexdigest()


def _turns(key: str, turns: Iterator) -> Iterator[tuple]:
    next(turns)
    place = 0
    for edit, role, text in turns:
        if role is not None:
            yield key, place, role, text, edit
            place += 1


def _with_id(out: DataFrame, rows: DataFrame, conv_col: str) -> DataFrame:
    kind = rows.schema[conv_col].dataType
    value: Column = F.when(F.col("key") != "", F.substr("key", F.lit(2))).cast(kind)
    return out.withColumn("key", value).withColumnRenamed("key", "conv_id")


def audit_conversations(rows: DataFrame, most: int = 256, most_bytes: int = 1 << 20, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row a conversation.

    rows: conv_col, turn, role, text and dropped (of `damaged`); dropped rows only keep their conversation
    in the result. Roles and texts are never null. Turns come in order of `turn`, nulls first, and turns
    of one number in the order of a hash of role and text. All rows with a null id are one conversation.
    One without rows has zeros, an empty audit and the hash of the empty text. An empty table gives an
    empty result.
    """
    return _with_id(conversations(rows, _audit, AUDITS, most, most_bytes, conv_col), rows, conv_col)


def repaired_turns(rows: DataFrame, most: int = 256, most_bytes: int = 1 << 20, conv_col: str = "conv_id") -> DataFrame:
    """conv_id, place, role, text, edit: the turns of the repaired conversations, numbered from 0; rows as in audit_conversations."""
    return _with_id(conversations(rows, _turns, TURNS, most, most_bytes, conv_col), rows, conv_col)
