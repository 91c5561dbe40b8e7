"""A seeded permutation of 0..n-1.

A row's new place is computed from its old one, inside the row: no sort and no
exchange. The numbers below n are written as pairs (left, right) of a grid of
``a`` by ``b`` cells, a about the root of n, and a Feistel network adds a keyed
function of one half to the other, in turn. Every such step can be undone, so
the network permutes the grid's cells. The few cells beyond n (fewer than a)
are walked on from: the network is applied again until a place below n comes,
which keeps it a permutation of 0..n-1.

The keyed function squares modulo a prime: t = (x * factor + addend) mod PRIME,
(t * t mod PRIME) div 8. All numbers stay below 2**62.
"""

from __future__ import annotations

import hashlib
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
PRIME = (1 << 31) - 1
#: Steps of a walk. A walk has at most a of them; on a grid with more, 64 steps
#: that all lead beyond n (each has a chance of 1 in 64 or less) raise an error.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """a, b with a * b >= n > a * (b - 1): fewer than a cells too many."""
    a = max(1, isqrt(max(n, 1)))
    return a, -(-max(n, 1) // a)


def keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """A factor and an addend below PRIME for each round."""
    out = []
    for r in range(rounds):
        h = hashlib.md5(f"{seed}|{r}".encode()).digest()
        out.append((int.from_bytes(h[:4], "big") % (PRIME - 1) + 1, int.from_bytes(h[4:8], "big") % PRIME))
    return out


def _again(place: Column, n: int, seed: int) -> Column:
    """One application as a fold over the keys, for the rows that walk."""
    a, b = grid(n)
    rounds = F.array(*[F.struct(F.lit(f).cast("long").alias("f"), F.lit(c).cast("long").alias("c"), F.lit(m).cast("long").alias("m"))
                       for (f, c), m in zip(keys(seed), [a, b] * ROUNDS)])

    def step(s, k):
        t = (s["y"] * k["f"] + k["c"]) % PRIME
        return F.struct(s["y"].alias("x"), ((s["x"] + F.shiftright(t * t % PRIME, 3)) % k["m"]).alias("y"))  # x, y: the half to change, the other
    # an even number of rounds: x is the left half at the end again
    start = F.struct(F.floor(place / F.lit(b)).alias("x"), (place % F.lit(b)).alias("y"))
    return F.aggregate(rounds, start, step, lambda s: s["x"] * b + s["y"])


def with_permuted(df: DataFrame, position: str, n: int, seed: int, out: str) -> DataFrame:
    """``out``: the new place of ``position`` (0..n-1, n below 2**52) under ``seed``."""
    if not 0 <= n < 1 << 52:
        raise ValueError("a permutation of fewer than 2**52 places")
    a, b = grid(n)
    half, t = ["_left", "_right"], "_t"
    d = df.withColumn("_left", F.floor(F.col(position) / F.lit(b))).withColumn("_right", F.col(position).cast("long") % F.lit(b))
    for r, (factor, addend) in enumerate(keys(seed)):  # a column a step: none is computed twice
        x, y = half[r % 2], half[1 - r % 2]
        d = d.withColumn(t, (F.col(y) * F.lit(factor).cast("long") + addend) % PRIME)
        d = d.withColumn(x, (F.col(x) + F.shiftright(F.col(t) * F.col(t) % PRIME, 3)) % (a if r % 2 == 0 else b))
    d = d.withColumn(t, F.col("_left") * b + F.col("_right"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(min(a, WALK))), F.col(t), lambda p, _: F.when(p < n, p).otherwise(_again(p, n, seed)))
    d = d.withColumn("_left", F.when(F.col(t) < n, F.col(t)).otherwise(walk))
    ended = F.when(F.col("_left") < n, F.col("_left")).otherwise(F.raise_error(F.lit("take another seed: a walk has not ended")).cast("long"))
    return d.withColumn(out, ended).drop("_left", "_right", t)


def permuted_sql(table: str, position: str, n: str, seed: int, out: str) -> str:
    """The same arithmetic as an SQL query over ``table`` (DuckDB): its columns
    and ``out``; ``n``, an SQL expression. Walks by recursion."""
    a = "greatest(1, CAST(floor(sqrt(n)) AS BIGINT))"

    def network(src: str, place: str, name: str) -> str:
        q = f"(SELECT *, {place} // b AS l, {place} % b AS r FROM {src})"
        for i, (factor, addend) in enumerate(keys(seed)):
            x, y, m = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
            q = f"(SELECT *, ({y} * {factor} + {addend}) % {PRIME} AS t FROM {q})"
            q = f"(SELECT * EXCLUDE (t) REPLACE (({x} + (t * t % {PRIME}) // 8) % {m} AS {x}) FROM {q})"
        return f"(SELECT * EXCLUDE (l, r), l * b + r AS {name} FROM {q})"
    sized = f"(SELECT *, CAST(ceil(n / a) AS BIGINT) AS b FROM (SELECT *, {a} AS a FROM (SELECT *, greatest(1, {n}) AS n FROM {table})))"
    return f"""WITH RECURSIVE walks AS (
  SELECT * FROM {network(sized, position, "walk_place")}
  UNION ALL SELECT * EXCLUDE (walk_place, walk_again), walk_again AS walk_place
  FROM {network("(SELECT * FROM walks WHERE walk_place >= n)", "walk_place", "walk_again")})
SELECT * EXCLUDE (n, a, b, walk_place), walk_place AS {out} FROM walks WHERE walk_place < n"""
