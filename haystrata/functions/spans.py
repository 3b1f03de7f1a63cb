"""Spans of pattern matches as array expressions: code-point offsets, half-open.

Places in a text are found by fixed pieces of it, as a substring counts characters from the start. Spark's ``aggregate``
copies what it has gathered at every step, so folds go over runs of ``RUN`` entries and gather small values (``running``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"
#: Characters of a piece, and its logarithm; entries of a run.
PIECE, SHIFT, RUN = 4096, 12, 256


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters; to be bound by ``once``, or a column."""
    return F.when(F.char_length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def between(blocks: Column, a: Column, b: Column) -> Column:
    """The characters from a to b of a text in ``pieces``."""
    i, j = F.shiftright(a.cast("int"), SHIFT), F.shiftright(b.cast("int"), SHIFT)
    at = lambda k: F.coalesce(F.get(blocks, k), F.lit(""))
    first = a.cast("int").bitwiseAND(F.lit(PIECE - 1)) + 1
    whole = F.when(j - i > 1, F.array_join(F.slice(blocks, i + 2, j - i - 1), "")).otherwise("")
    long = F.concat(F.substring(at(i), first, F.lit(PIECE)), whole, F.substring(at(j), F.lit(1), b.cast("int").bitwiseAND(F.lit(PIECE - 1))))
    return F.when(i == j, F.substring(at(i), first, (b - a).cast("int"))).otherwise(long)


def running(items: Column, zero: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """array<kind>: for each item what ``emit`` makes of the state before it and the item; ``step`` is the state behind it."""

    def over(state: Column, run: Column, gathered: Column) -> Column:
        start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        inner = F.aggregate(run, start, lambda a, x: F.struct(step(a["state"], x).alias("state"), F.array_append(a["out"], emit(a["state"], x)).alias("out")))
        return once(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(gathered, r["out"]).alias("out")))

    start = F.struct(zero.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / RUN).cast("int")), lambda k: F.slice(items, k * RUN + 1, F.lit(RUN)))
    return F.when(F.size(items) == 0, F.expr(f"cast(array() as array<{kind}>)")).otherwise(F.aggregate(runs, start, lambda a, run: over(a["state"], run, a["out"]), lambda a: F.flatten(a["out"])))


def spans(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """array<struct<s, e, v>> of all matches, in order.

    ``split`` gives the text between matches and ``regexp_extract_all`` the matches: offsets are
    running sums of their lengths. The fold runs only where the pattern occurs; ``guard`` is a
    cheaper necessary condition.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.char_length(g))

    def placed(h: Column) -> Column:
        pairs = F.zip_with(gaps, h, lambda g, v: F.struct(g.alias("g"), F.coalesce(F.char_length(v), F.lit(0)).alias("n")))
        starts = once(pairs, lambda p: running(p, F.lit(0), lambda at, x: at + x["g"] + x["n"], lambda at, x: at + x["g"], "int"))
        return F.filter(F.zip_with(h, starts, lambda v, at: F.struct(at.alias("s"), (at + F.char_length(v)).alias("e"), v.alias("v"))), lambda x: x["v"].isNotNull())

    found = once(hits, placed)
    occurs = text.rlike(pattern) if guard is None else F.when(guard, text.rlike(pattern)).otherwise(F.lit(False))
    return F.when(occurs, found).otherwise(F.expr(f"cast(array() as {SPAN})"))


def window(blocks: Column, span: Column, width: int) -> Column:
    """The span with ``width`` characters on either side, of a text in ``pieces``."""
    return between(blocks, F.greatest(span["s"] - width, F.lit(0)), span["e"] + width)


def claim(stages: list[Column], kind: str) -> Column:
    """Candidates in order of stage and place that overlap no earlier claim. Candidates of a stage, in order of place, must not overlap.

    Claims are kept in order of place. A stage's candidates are sorted in among them, and one sweep drops those that begin before the last
    claim's end or end behind the next claim's beginning; the verdict on an entry is known at the next one.
    """
    one = kind.removeprefix("array<").removesuffix(">")
    placed = f"struct<s:int,rank:int,k:int,e:int,c:{one}>"
    entry = lambda c, rank, k: F.struct(c["s"].alias("s"), F.lit(rank).alias("rank"), k.alias("k"), c["e"].alias("e"), c.alias("c"))
    settled = lambda p: F.struct(p["s"].alias("s"), F.lit(0).alias("rank"), p["k"].alias("k"), p["e"].alias("e"), p["c"].alias("c"))
    last = F.struct(F.lit(2**31 - 1).alias("s"), F.lit(0).alias("rank"), F.lit(2**31 - 1).alias("e"))

    def sweep(state: Column, x: Column) -> Column:
        """state: end of the last claim; whether the entry before was one (2), may be dropped yet (1) or is dropped (0); its end."""
        claimed = x["rank"] == 0
        end = F.when(state["was"] == 2, F.greatest(state["end"], state["e"])).otherwise(state["end"])
        return F.struct(end.alias("end"), F.when(claimed, 2).when(x["s"] >= end, 1).otherwise(0).alias("was"), x["e"].alias("e"))

    def verdict(state: Column, x: Column) -> Column:
        return (state["was"] == 2) | ((state["was"] == 1) & ~((x["rank"] == 0) & (x["s"] < state["e"])))

    def merged(both: Column) -> Column:
        light = F.concat(F.transform(both, lambda p: F.struct(p["s"].alias("s"), p["rank"].alias("rank"), p["e"].alias("e"))), F.array(last))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("was"), F.lit(0).alias("e"))
        kept = once(light, lambda x: F.slice(running(x, start, sweep, verdict, "boolean"), F.lit(2), F.size(x)))
        return F.transform(F.filter(F.zip_with(both, kept, lambda p, fine: F.struct(p.alias("p"), fine.alias("fine"))), lambda z: z["fine"]), lambda z: settled(z["p"]))

    def stage(acc: Column, x: Column) -> Column:
        new = F.transform(x["found"], lambda c: entry(c, 1, x["k"]))
        both = F.array_sort(F.concat(acc, new), lambda p, q: F.when(p["s"] != q["s"], p["s"] - q["s"]).otherwise(p["rank"] - q["rank"]))
        return F.when(F.size(x["found"]) == 0, acc).when(F.size(acc) == 0, F.transform(new, settled)).otherwise(once(both, merged))

    numbered = F.array(*(F.struct(F.lit(k).alias("k"), s.alias("found")) for k, s in enumerate(stages)))
    held = F.aggregate(numbered, F.expr(f"cast(array() as array<{placed}>)"), stage)
    ordered = F.array_sort(held, lambda p, q: F.when(p["k"] != q["k"], p["k"] - q["k"]).otherwise(p["s"] - q["s"]))
    return F.transform(ordered, lambda p: p["c"])


def splice(text: Column, found: Column) -> Column:
    """The text with every span replaced by its mask."""
    ordered = F.array_sort(found, lambda a, b: a["s"] - b["s"])

    def joined(blocks: Column) -> Column:
        return once(ordered, lambda o: F.array_join(F.concat(F.transform(o, lambda x, k: F.concat(between(blocks, F.when(k == 0, 0).otherwise(F.get(o, k - 1)["e"]), x["s"]), x["mask"])), F.array(between(blocks, F.coalesce(F.get(o, F.size(o) - 1)["e"], F.lit(0)), F.char_length(text)))), ""))

    return once(pieces(text), joined)


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space to one space, none at the ends."""
    from haystrata.functions.patterns import WS

    return F.regexp_replace(F.regexp_replace(text, f"{WS}+", " "), "^ | $", "")
