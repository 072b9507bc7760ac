"""Chat formatting: roles recovered from plain transcripts by a hidden Markov model, then rendered.

Transcript rows: conv_id, block, place, line and gap (whether a blank line or nothing comes before;
null: no); further columns ignored. block and place order the
lines of a conversation and blocks bound what one task decodes at a time: no block should hold more
lines than fit memory (`transcripts` keeps TURNS_PER_BLOCK turns in one). A null line counts as
empty. Rows with a null conv_id form one conversation. Lines with equal block and place are
ordered by their text.

The model's states are the first and the further lines of each role's turns. A line's feature is
its speaker marker (system-like, user-like, assistant-like or none), whether it ends as a question,
whether it is short, and whether it follows a gap. Viterbi decoding runs in three steps, so one conversation may span many
tasks: each block gives the best score from every entry state to every exit state (max-plus), the
blocks of a conversation are chained, and each block is decoded between its known ends. Ties go to
the lower state.

Turns are rendered in one canonical form: a marker of the turn's own role is stripped, and the blank line that parts
turns. Emissions are counted on the conversations of the fit half (by crc32 of conv_id) only; the others are parsed by what
was learned there. Text that already holds the
rendering's control strings keeps them with a space after the opening bracket.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colloquy.llm.common import staged

ROLES = ("system", "user", "assistant")
TURNS_PER_BLOCK = 256
STATES = 2 * len(ROLES)  # role r: state 2r begins a turn, 2r + 1 goes on
SHORT = 40

# Names that mark a speaker, by role.
MARKERS = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "customer", "prompter", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "a"),
}
_NAMES = {n: r for r, names in enumerate(MARKERS.values()) for n in names}
MARKER = re.compile(r"^\s*(?:#+\s*|\*\*|\[|<\|?)?(" + "|".join(sorted(_NAMES, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*(?::\*\*|:|>|(?<=\])|(?<=>))\s*", re.IGNORECASE)

# Prior log odds of the model; `fit` replaces the emissions by counts.
_START = np.log(np.array([0.3, 1e-6, 0.55, 1e-6, 0.15, 1e-6]))


def _transitions() -> np.ndarray:
    follow = np.array([[0.02, 0.93, 0.05], [0.02, 0.08, 0.9], [0.02, 0.9, 0.08]])  # next role after a turn
    out = np.full((STATES, STATES), 1e-9)
    for r in range(3):
        for s in (2 * r, 2 * r + 1):
            out[s, 2 * r + 1] = 0.5
            for n in range(3):
                out[s, 2 * n] = 0.5 * follow[r, n]
    return np.log(out)


FEATURES = 32


def feature(line: str | None, gap: bool | None) -> int:
    """gap * 16 + marker (none, or of role r: 1 + r) * 4 + question * 2 + short."""
    line = line or ""
    found = MARKER.match(line)
    marker = 1 + _NAMES[found[1].lower()] if found else 0
    return 16 * bool(gap) + marker * 4 + 2 * line.rstrip().endswith("?") + (len(line) < SHORT)


def unmarked(line: str, role: int) -> str:
    """A turn's first line without the marker, if it has one of this role."""
    found = MARKER.match(line)
    return line[found.end() :] if found and _NAMES[found[1].lower()] == role else line


def prior_emissions() -> np.ndarray:
    """log P(feature | state): markers begin the turns of their role, seldom another's."""
    out = np.zeros((STATES, FEATURES))
    for r in range(3):
        for begins in (0, 1):
            for f in range(FEATURES):
                gap, marker, question, short = f // 16, f // 4 % 4, f // 2 % 2, f % 2
                if begins:
                    p = 0.25 if not marker else 0.7 if marker == 1 + r else 0.025
                else:
                    p = 0.985 if not marker else 0.005
                q = 0.35 if r == 1 else 0.12
                g = 0.9 if begins else 0.1
                out[2 * r + 1 - begins, f] = p * (q if question else 1 - q) * (0.4 if short else 0.6) * (g if gap else 1 - g)
    return np.log(out)


def fit_emissions(counts: list[tuple[int, int, int]], weight: float = 20.0) -> np.ndarray:
    """log P(feature | state) from counts (state, feature, n), with the prior worth `weight` lines a state."""
    table = weight * np.exp(prior_emissions())
    for s, f, n in counts:
        table[s, f] += n
    return np.log(table / table.sum(axis=1, keepdims=True))


def _groups(frames: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, in order, across batches."""
    now, rows = None, []
    for batch in frames:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if rows and key != now:
                yield now, rows
                rows = []
            now = key
            rows.append(row)
    if rows:
        yield now, rows


def viterbi_block(features: list[int], emit: np.ndarray) -> np.ndarray:
    """Best scores from each state before the block (rows) to each state at its end."""
    trans = _transitions()
    score = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
    for f in features:
        score = (score[:, :, None] + trans[None]).max(axis=1) + emit[:, f]
    return score


def viterbi_path(features: list[int], emit: np.ndarray, entry: int | None, last: int | None) -> list[int]:
    """The best states of a block after state entry (None: at the start), ending in state last (None: any)."""
    trans, back = _transitions(), []
    score = _START + emit[:, features[0]] if entry is None else trans[entry] + emit[:, features[0]]
    for f in features[1:]:
        step = score[:, None] + trans
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + emit[:, f]
    path = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def _summaries(emit: np.ndarray):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _groups(frames, ("conv_id", "block")):
            fs = [feature(r["line"], r["gap"]) for r in rows]
            head = _START + emit[:, fs[0]]
            rest = viterbi_block(fs[1:], emit)
            start = (head[:, None] + rest).max(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([block], pa.int64()), pa.array([viterbi_block(fs, emit).ravel().tolist()], pa.list_(pa.float64())), pa.array([start.tolist()], pa.list_(pa.float64()))], ["conv_id", "block", "through", "start"])

    return run


def _chain(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (conv,), rows in _groups(frames, ("conv_id",)):
        score, back = np.array(rows[0]["start"]), []
        for r in rows[1:]:
            step = score[:, None] + np.array(r["through"]).reshape(STATES, STATES)
            back.append(step.argmax(axis=0))
            score = step.max(axis=0)
        ends = [int(score.argmax())]
        for b in reversed(back):
            ends.append(int(b[ends[-1]]))
        ends = ends[::-1]
        n = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array([r["block"] for r in rows], pa.int64()), pa.array([None, *ends[:-1]], pa.int32()), pa.array(ends, pa.int32())], ["conv_id", "block", "entry", "last"])


def _decode(emit: np.ndarray):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (conv, block), rows in _groups(frames, ("conv_id", "block")):
            lines = [r["line"] or "" for r in rows]
            path = viterbi_path([feature(r["line"], r["gap"]) for r in rows], emit, rows[0]["entry"], rows[0]["last"])
            n, begun, order = len(rows), 0, []
            for k, s in enumerate(path):
                begun += s % 2 == 0
                order.append(begun)
            bare = [unmarked(x, s // 2) if s % 2 == 0 else x for x, s in zip(lines, path, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([conv] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([ROLES[s // 2] for s in path]), pa.array(order, pa.int64()), pa.array(bare)], ["conv_id", "block", "at", "role", "begun", "line"])

    return run


def decode(lines: DataFrame, emit: np.ndarray) -> DataFrame:
    """conv_id, block, at, role, begun (turns begun in the block so far) and line (marker stripped)."""
    rows = lines.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("block").cast("long").alias("block"), "place", F.col("line").cast("string").alias("line"), F.col("gap").cast("boolean").alias("gap"))
    source = staged(rows, "lines")
    together = lambda df: df.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place", "line")
    summary = together(source).select("conv_id", "block", "line", "gap").mapInArrow(_summaries(emit), "conv_id long, block long, through array<double>, start array<double>")
    ends = summary.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_chain, "conv_id long, block long, entry int, last int")
    both = source.alias("s").join(staged(ends, "ends").alias("e"), F.col("s.conv_id").eqNullSafe(F.col("e.conv_id")) & F.col("s.block").eqNullSafe(F.col("e.block")))
    return together(both.select("s.conv_id", "s.block", "s.place", "s.line", "s.gap", "e.entry", "e.last")).select("conv_id", "block", "line", "gap", "entry", "last").mapInArrow(_decode(emit), "conv_id long, block long, at long, role string, begun long, line string")


def render(decoded: DataFrame) -> DataFrame:
    """One row for each turn: conv_id, turn (from 0), role, content and rendered."""
    per_block = decoded.groupBy("conv_id", "block").agg(F.max("begun").alias("n"))
    before = per_block.select("conv_id", "block", F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    d, b = decoded.alias("d"), before.alias("b")
    numbered = d.join(b, F.col("d.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("d.block").eqNullSafe(F.col("b.block")))
    numbered = numbered.select("d.conv_id", "d.block", "d.at", "d.role", "d.line", F.greatest(F.col("b.before") + F.col("d.begun") - 1, F.lit(0)).alias("turn"))
    turns = numbered.groupBy("conv_id", "turn").agg(F.min_by("role", F.struct("block", "at")).alias("role"), F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("l"))
    content = turns.select("conv_id", "turn", "role", F.regexp_replace(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), r"\n\z", "").alias("content"))
    safe = F.regexp_replace("content", r"<\|(system|user|assistant|end)\|>", r"< |$1|>")
    return content.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), safe, F.lit("\n<|end|>")))


# How a transcript names the roles, one style for each conversation.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: "},
    {"system": "### Instructions: ", "user": "### Human: ", "assistant": "### Assistant: "},
    {"system": "[system] ", "user": "[user] ", "assistant": "[bot] "},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: "},
)


def transcripts(turns: DataFrame) -> DataFrame:
    """Plain transcripts of a table of turns (conv_id, turn, role, text), a blank line after each turn: conv_id, block, place, line, gap,
    and what is true of the line: its turn, role and whether it begins the turn. The style follows
    from conv_id; every fifth turn by (conv_id + turn) bears no marker, as in careless transcripts. Null
    roles and roles unknown to the model bear none either; null turns come first."""
    style = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(len(STYLES)))
    mark = F.lit("")
    for k, names in enumerate(STYLES):
        for role, marker in names.items():
            mark = F.when((style == k) & (F.col("role") == role), F.lit(marker)).otherwise(mark)
    bare = F.pmod(F.coalesce("conv_id", F.lit(0)) + F.coalesce("turn", F.lit(0)), F.lit(5)) == 4
    split = F.split(F.concat(F.when(bare, F.lit("")).otherwise(mark), F.coalesce("text", F.lit("")), F.lit("\n")), "\n", -1)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    lines = rows.select("conv_id", "turn", "role", split.alias("all")).select("conv_id", "turn", "role", F.posexplode(F.transform("all", lambda x, i: F.struct(x.alias("line"), F.coalesce(F.trim(F.get("all", i - 1)) == "", F.lit(True)).alias("gap")))).alias("pos", "at"))
    return lines.select("conv_id", F.floor(F.coalesce("turn", F.lit(0)) / TURNS_PER_BLOCK).cast("long").alias("block"), F.struct("turn", "role", "pos").alias("place"), "at.line", "at.gap", "turn", "role", (F.col("pos") == 0).alias("begins"))


def in_fit_half(conv_id: Column) -> Column:
    return F.coalesce(F.crc32(conv_id.cast("string")) % 2 == 0, F.lit(False))


def learned_emissions(lines: DataFrame) -> np.ndarray:
    """Emissions counted over the transcript lines of the fit half whose role is known. The driver gets at most 192 counts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            seen: dict[tuple[int, int], int] = {}
            for role, begins, line, gap in zip(*[batch.column(c).to_pylist() for c in ("role", "begins", "line", "gap")], strict=True):
                key = (2 * ROLES.index(role) + (not begins), feature(line, gap))
                seen[key] = seen.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["state", "feature", "n"])

    known = lines.where(in_fit_half(F.col("conv_id")) & F.col("role").isin(*ROLES)).select("role", "begins", "line", "gap")
    counts = known.mapInArrow(run, "state int, feature int, n long").groupBy("state", "feature").agg(F.sum("n").alias("n"))
    return fit_emissions([tuple(r) for r in counts.collect()])


def format_conversations(turns: DataFrame) -> DataFrame:
    """Transcripts of the turns, parsed back and rendered: conv_id, turn, role, content, rendered."""
    lines = transcripts(turns)
    return render(staged(decode(lines, learned_emissions(lines)), "decoded"))
