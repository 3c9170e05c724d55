"""Filling fixed-capacity containers with items: configuration linear program over the length histogram.

The program asks for the least (fractional) number of containers whose configurations cover every length. Multiplicative
weights solve it: a length's price is its size, multiplied down as it gets covered; the next configuration is the best one
at these prices by dynamic-programming knapsack, and a share of what its scarcest length still needs is added to its
fractional count. Any prices give a dual bound, the best of which is kept. Then the counts are rounded down, and the items
that remain are packed by the same knapsack in whole containers.

Each window's program runs in a task of its own on its histogram, at most `capacity` rows. The plan is a table of rank
intervals per length, bounded by the configurations, whatever the number of items; items get their rank in their length
in one sorted scan, over as many partitions as a length needs, and look their container up in the plan.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlode.llm.encoding import encode
from chatlode.llm.scans import numbered
from chatlode.session import checkpointed, table

#: Grid of the knapsack: capacities beyond it are priced in steps of capacity / GRID, lengths rounded up.
GRID = 1024
#: Rows of the plans that are shipped to all tasks; each configuration gives one per length in it.
PLAN_ROWS = 2_000_000


def knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """Counts of each class in the configuration of highest price that fits `room`, by dynamic programming. `sizes` are distinct."""
    price = np.full(room + 1, -np.inf)
    price[sizes] = prices
    back = np.zeros(room + 1)  # back[room - w] is the best price of a room of w, so that candidates lie side by side
    buf = np.empty(room + 1)
    low = int(sizes.min())
    for w in range(low, room + 1):
        v = np.add(back[room - w + low : room + 1], price[low : w + 1], out=buf[: w - low + 1]).max()
        p = back[room - w + 1]
        back[room - w] = v if v > p else p
    out, at = np.zeros(len(sizes), np.int64), {int(s): i for i, s in enumerate(sizes)}
    w = room
    while w >= low:
        if back[room - w] == back[room - w + 1]:
            w -= 1
            continue
        s = low + int((back[room - w + low : room + 1] + price[low : w + 1]).argmax())
        out[at[s]] += 1
        w -= s
    return out


def program(sizes: np.ndarray, counts: np.ndarray, room: int, share: float = 1.0, lean: float = 1.06, bend: float = 0.25, rest: float = 0.02) -> tuple[list[tuple[np.ndarray, float]], float]:
    """(configurations with their fractional counts, dual bound on the number of containers).

    `share` of what the scarcest length of a configuration still needs, all of it by default, is added at each step; a
    length's weight falls with the power `bend` of the part that it still needs, `lean` makes long items dearer than their
    length, as they are the harder to place. It ends when all but `rest` of the volume is covered: the rounding places the rest.
    """
    need, volume = counts.astype(float), float((counts * sizes).sum())
    base = sizes.astype(float) ** lean
    bound = volume / room
    got: dict[bytes, list] = {}
    while float((need * sizes).sum()) > rest * volume:
        some = np.flatnonzero(need > 1e-9)
        y = base[some] * (need[some] / counts[some]) ** bend
        c = knapsack(sizes[some], y, room)
        # Prices over the value of the best configuration are feasible in the dual program.
        bound = max(bound, float((y * counts[some]).sum() / (y * c).sum()))
        used = np.flatnonzero(c)
        step = share * float((need[some][used] / c[used]).min())
        step = step if step >= 1 else step / share  # what few items need is given at once
        whole = np.zeros(len(sizes), np.int64)
        whole[some] = c
        need = np.maximum(0.0, need - whole * step)
        need[need < 1e-3] = 0
        got.setdefault(whole.tobytes(), [whole, 0.0])[1] += step
    return [(c, x) for c, x in got.values()], bound


def top_up(c: np.ndarray, sizes: np.ndarray, rest: np.ndarray, room: int) -> np.ndarray:
    """`c` within the counts `rest`, its free room filled with the largest classes that are left."""
    c = np.minimum(c, rest)
    free = room - int((c * sizes).sum())
    k = int(np.searchsorted(sizes, free, "right")) - 1
    while k >= 0 and free >= sizes[0]:
        more = min(int(rest[k] - c[k]), free // int(sizes[k]))
        if more > 0:
            c[k] += more
            free -= more * int(sizes[k])
        k = min(k - 1, int(np.searchsorted(sizes, free, "right")) - 1)
    return c


def configurations(sizes: np.ndarray, counts: np.ndarray, room: int, share: float = 0.34, lean: float = 1.06, bend: float = 0.25):
    """Yields (configuration, copies), whole, until `counts` is covered: the program's counts rounded down, then what remains
    by further knapsacks, each topped up with what is left. `sizes` are sorted."""
    rest, base = counts.copy(), sizes.astype(float) ** lean
    for c, x in program(sizes, counts, room)[0]:
        used = np.flatnonzero(c)
        k = min(int(x), int((rest[used] // c[used]).min()))
        if k:
            rest -= c * k
            yield c, k
    total = rest.copy()
    while True:
        some = np.flatnonzero(rest)
        if not len(some):
            return
        s, r = sizes[some], rest[some]
        c = top_up(knapsack(s, base[some] * (r / total[some]) ** bend, room), s, r, room)
        used = np.flatnonzero(c)
        k = max(1, int(share * float((r[used] / c[used]).min())))
        rest[some] -= c * k
        whole = np.zeros(len(sizes), np.int64)
        whole[some] = c
        yield whole, k


def plan(lengths: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rank intervals (length, low, high, first container, slot, slots in a container) and the number of containers.

    Item number r of a length, low <= r < high, goes to container first + (slot + r - low) // slots.
    """
    step = max(1, -(-capacity // GRID))
    left = {s: n for s, n in lengths.items() if n > 0 and s > 0}
    given = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0
    classes: dict[int, list[int]] = {}
    for s in sorted(left, reverse=True):
        classes.setdefault(min(-(-s // step), capacity // step), []).append(s)
    sizes = np.array(sorted(classes), np.int64)
    counts = np.array([sum(left[s] for s in classes[int(k)]) for k in sizes], np.int64)
    for c, k in configurations(sizes, counts, capacity // step) if len(sizes) else ():
        for u in np.flatnonzero(c):
            slot, need = 0, int(c[u]) * k
            for s in classes[int(sizes[u])]:
                q = min(need, left[s])
                if q:
                    out.append((s, given[s], given[s] + q, bins, slot, int(c[u])))
                    given[s] += q
                    left[s] -= q
                    slot += q
                    need -= q
        bins += k
    return out, bins


_PLAN = "window_name string, rest long, low long, first long, slot long, slots long"


def _plans(pdf: pd.DataFrame) -> pd.DataFrame:
    """Plan of one window from its histogram."""
    rows, _ = plan(dict(zip(pdf["rest"].tolist(), pdf["n"].tolist())), int(pdf.capacity.iloc[0]))
    out = pd.DataFrame([(r[0], r[1], r[3], r[4], r[5]) for r in rows], columns=["rest", "low", "first", "slot", "slots"])
    return out.assign(window_name=pdf.window_name.iloc[0])[["window_name", "rest", "low", "first", "slot", "slots"]]


_PUT = "window_name string, container_id string, doc_id long, piece int, start_token long, n_tokens long"


def _put(batches, plans):
    """Containers of ranked items: the last interval of their length that begins at or before their rank."""
    for b in batches:
        n, bins = b.num_rows, np.zeros(b.num_rows, np.int64)
        units = b.column("unit").dictionary_encode()
        codes, rank = units.indices.to_numpy(zero_copy_only=False), b.column("position").to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        cuts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0, True]) if n else []
        for a, z in zip(cuts[:-1], cuts[1:]):
            at = order[a:z]
            low, first, slot, slots = plans.value[units.dictionary[int(codes[at[0]])].as_py()]
            k = np.searchsorted(low, rank[at], "right") - 1
            bins[at] = first[k] + (slot[k] + rank[at] - low[k]) // slots[k]
        names = pa.array([f"m{k}" for k in bins.tolist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("window_name"), names, *(b.column(c) for c in ("doc_id", "piece", "start_token", "rest"))], names=["window_name", "container_id", "doc_id", "piece", "start_token", "n_tokens"])


def pack(items: DataFrame, windows: DataFrame) -> DataFrame:
    """window_name, container_id, doc_id, piece, start_token, n_tokens: an assignment of `items` (doc_id, n_tokens).

    Only an item larger than the capacity is split: into pieces that fill containers of their own and one remainder that
    is packed like an item. Items of no tokens (null counts included) take no room: one row without a container.
    Repeated ids are items of their own; windows without a name or a capacity are none. Containers of a window are numbered 'm<k>'; full pieces 'f<doc_id>.<piece>'.
    """
    spark = items.sparkSession
    caps = [(r[0], int(r[1])) for r in windows.select("window_name", "capacity_tokens").where("capacity_tokens > 0 and window_name is not null").distinct().limit(10_000).collect()]
    if not caps:
        return spark.createDataFrame([], _PUT)
    sized = items.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
    each = sized.select("doc_id", "n", F.explode(F.array(*[F.struct(F.lit(w).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for w, c in caps])).alias("w")).select("doc_id", "n", "w.*")
    each = each.withColumn("full", F.floor(F.col("n") / F.col("capacity"))).withColumn("rest", F.col("n") % F.col("capacity"))
    whole = each.where("full > 0").select("window_name", "doc_id", "capacity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("piece"))
    whole = whole.select("window_name", F.format_string("f%d.%d", "doc_id", "piece").alias("container_id"), "doc_id", F.col("piece").cast("int"), (F.col("piece") * F.col("capacity")).alias("start_token"), F.col("capacity").alias("n_tokens"))
    none = each.where("n = 0").select("window_name", F.lit(None).cast("string").alias("container_id"), "doc_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_token"), F.lit(0).cast("long").alias("n_tokens"))
    rest = each.where("rest > 0").select("window_name", "capacity", F.format_string("%s|%d", "window_name", "rest").alias("unit"), "doc_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("start_token"), "rest")

    hist = rest.groupBy("window_name", "capacity", "rest").agg(F.count("*").alias("n"))  # at most `capacity` rows a window
    plans: dict[str, list] = {}
    rows = hist.repartition(len(caps), "window_name").groupBy("window_name").applyInPandas(_plans, _PLAN).limit(PLAN_ROWS + 1).collect()
    if len(rows) > PLAN_ROWS:
        raise ValueError(f"the plans have more than {PLAN_ROWS} rows")
    for r in rows:
        plans.setdefault(f"{r.window_name}|{r.rest}", []).append((r.low, r.first, r.slot, r.slots))
    shipped = spark.sparkContext.broadcast({u: tuple(np.array(sorted(x), np.int64).T) for u, x in plans.items()})
    order = ["unit", "doc_id", "piece"]
    ranked = numbered(rest.repartitionByRange(*order).sortWithinPartitions(*order), "unit", ["window_name", "doc_id", "piece", "start_token", "rest"])
    mixed = ranked.mapInArrow(partial(_put, plans=shipped), _PUT)
    return whole.unionByName(mixed).unionByName(none)


def p8_containers(spark, sf_dir: str) -> DataFrame:
    """Assignment of the texts of documents to containers of each size in context_windows, in byte_bpe_50k tokens."""
    sizes = checkpointed(encode(table(spark, sf_dir, "documents"), lengths=True))
    return pack(sizes, table(spark, sf_dir, "context_windows"))


def p8_unused(spark, sf_dir: str) -> DataFrame:
    """Containers, tokens, unused share and the least containers that the volume allows, of each window."""
    t = p8_containers(spark, sf_dir).where("container_id is not null").groupBy("window_name", "container_id").agg(F.sum("n_tokens").alias("tokens"))
    t = t.groupBy("window_name").agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"))
    c = table(spark, sf_dir, "context_windows")
    room = F.col("capacity_tokens")
    return t.join(F.broadcast(c.limit(10_000)), "window_name").select("window_name", "containers", "tokens", F.ceil(F.col("tokens") / room).alias("volume_bound"), (1 - F.col("tokens") / (F.col("containers") * room)).alias("unused"))
