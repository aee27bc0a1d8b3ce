"""Selection under a budget: what no single window can say runs as one Arrow group for each query."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources.tables import deal


def cap_by_file(df: DataFrame, order: list[Column], by: list[str], file: str = "file_path", per_file: int = 2, files: int = 5, total: int = 10) -> DataFrame:
    """The first rows in ``order`` with at most ``per_file`` of a file, ``files`` files and ``total`` rows for each ``by``; a file past the caps stays out.

    Exact in three windows: rank in the file, rank of the file by its first row, running count of what is left.
    """
    w = W.partitionBy(*by)
    d = df.withColumn("__n", F.row_number().over(w.orderBy(*order)))
    d = d.withColumn("__in_file", F.row_number().over(W.partitionBy(*by, file).orderBy("__n"))).withColumn("__first", F.min("__n").over(W.partitionBy(*by, file)))
    d = d.withColumn("__file", F.dense_rank().over(w.orderBy("__first"))).where((F.col("__in_file") <= per_file) & (F.col("__file") <= files))
    return d.withColumn("__k", F.row_number().over(w.orderBy("__n"))).where(F.col("__k") <= total).drop("__n", "__in_file", "__first", "__file", "__k")


def prefix_budget(df: DataFrame, by: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """The rows in order whose running cost stays within the budget."""
    return df.withColumn("__c", F.sum(cost).over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))).where(F.col("__c") <= budget).drop("__c")


#: Weight of a bundle's files by tier when a prompt is packed, and the parts of the gain of a bundle.
PACK_TIER = {"core": 1.0, "stub": 0.5, "doc": 0.35, "example": 0.25, "test": 0.15}
NEW_FILE, MORE_FILES, NEW_ROLE, NEW_STEP, ACTIVE, PASSIVE, SAME_FILE, MOST_SATURATION, LEAST_GAIN = 0.35, 0.08, 0.20, 0.10, 0.05, -0.03, -0.15, 0.5, 0.001
BUNDLE = "bundle string, role string, passive boolean, utility double, weight double, bridge double, files array<struct<path:string,weight:double>>, steps array<string>, symbols array<struct<uid:string,tokens:bigint,semantic:double>>"


class Coverage:
    """What a prompt holds so far, and what a bundle would add to it."""

    def __init__(self, file_cap: int, semantic: float = 0.0):
        self.file_cap, self.semantic = max(1, file_cap), semantic
        self.files: dict[str, int] = {}
        self.tokens: dict[str, int] = {}
        self.roles: set[str] = set()
        self.steps: set[str] = set()
        self.printed: set[str] = set()

    def fresh(self, b: dict) -> list[dict]:
        """The symbols of a bundle that are not printed yet; of a repeated one the first."""
        out: dict[str, dict] = {}
        for s in b["symbols"]:
            if s["uid"] not in self.printed:
                out.setdefault(s["uid"], s)
        return list(out.values())

    def cost(self, b: dict) -> int:
        return sum(int(s["tokens"]) for s in self.fresh(b))

    def gain(self, b: dict) -> float:
        weights = {f["path"]: f["weight"] for f in b["files"]}
        new = [w for p, w in weights.items() if p not in self.files]
        g = b["utility"] * b["weight"] + b["bridge"] * b["weight"] + (PASSIVE if b["passive"] else ACTIVE)
        if new:
            g += (NEW_FILE + MORE_FILES * (len(new) - 1)) * max(new)
        if b["role"] not in self.roles:
            g += NEW_ROLE
        g += NEW_STEP * len(set(b["steps"]) - self.steps) + SAME_FILE * sum(self.files.get(p, 0) for p in weights)
        if b["files"]:
            g -= min(MOST_SATURATION, self.tokens.get(b["files"][0]["path"], 0) / self.file_cap)
        if self.semantic:
            told = [s for s in self.fresh(b) if s["tokens"] > 0]
            g += self.semantic * sum(s["tokens"] * min(1.0, max(0.0, s["semantic"] or 0.0)) for s in told) / max(1, sum(s["tokens"] for s in told))
        return g

    def take(self, b: dict, cost: int) -> None:
        for p in {f["path"] for f in b["files"]}:
            self.files[p] = self.files.get(p, 0) + 1
        if b["files"]:
            self.tokens[b["files"][0]["path"]] = self.tokens.get(b["files"][0]["path"], 0) + cost
        self.roles.add(b["role"])
        self.steps |= set(b["steps"])
        self.printed |= {s["uid"] for s in b["symbols"]}


def hope(b: dict) -> float:
    """What a bundle is worth for each token before anything is known of the rest."""
    cost = sum({s["uid"]: int(s["tokens"]) for s in reversed(b["symbols"])}.values())
    g = (b["utility"] + NEW_FILE + NEW_ROLE + b["bridge"]) * b["weight"] + NEW_STEP * len(set(b["steps"])) + (0.0 if b["passive"] else ACTIVE)
    return g / max(1, cost)


def choose(bundles: list[dict], budget: int, file_share: float = 0.25, semantic: float = 0.0, least: float | None = None) -> list[tuple[str, int, float]]:
    """``bundle, tokens, gain`` in the order they are bought: greedy by gain for each token, priced anew when a bundle's turn comes.

    A price pays for symbols not printed yet. A bundle that turns out worth less than the next one's last price goes back in line; one that no longer fits,
    or is worth no more than ``least`` for a token, is passed over. The first always fits. Equal values go by the bundle's place in the list.
    """
    state = Coverage(int(budget * file_share), semantic)
    heap = [(-hope(b), i) for i, b in enumerate(bundles)]
    heapq.heapify(heap)
    used, out = 0, []
    while heap and (not out or used < budget):
        _, i = heapq.heappop(heap)
        b = bundles[i]
        cost, gain = state.cost(b), state.gain(b)
        value = max(LEAST_GAIN, gain) / max(1, cost)
        if heap and value + 1e-12 < -heap[0][0]:
            heapq.heappush(heap, (-value, i))
            continue
        if least is not None and cost > 0 and gain / cost <= least or out and used + cost > budget:
            continue
        out.append((b["bundle"], cost, gain))
        used += cost
        state.take(b, cost)
    return out


def pack(bundles: DataFrame, query: str, budget: int, file_share: float = 0.25, semantic: float = 0.0, least: float | None = None) -> DataFrame:
    """``query, bundle, place, tokens, gain``: the bundles of each query that a prompt of ``budget`` tokens gets; see choose().

    ``bundles``: the query and the columns of ``BUNDLE``; utility is positive and finite, files are in order (the first is the main one). Repeated bundles
    count once. A query's bundles are what retrieval found for it, never a table's rows; they meet in one task.
    """
    kind = dict(bundles.dtypes)[query]
    names = [c.split(" ")[0] for c in BUNDLE.split(", ")]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.drop_duplicates("bundle").sort_values("bundle", kind="stable").to_dict("records")
        got = choose(rows, budget, file_share, semantic, least)
        return pd.DataFrame({query: [pdf[query].iloc[0]] * len(got), "bundle": [g[0] for g in got], "place": range(1, len(got) + 1), "tokens": [g[1] for g in got], "gain": [g[2] for g in got]})

    return deal(bundles.select(query, *names), query).groupBy(query).applyInPandas(one, f"{query} {kind}, bundle string, place int, tokens long, gain double")


def leaders(pool: DataFrame, query: str, utility: str, budget: int, k: float = 1.0) -> DataFrame:
    """``query, noise, leaders, step_limit``: how far the weak half of a pool's utilities reaches towards its peak, who stands out, and what one of them may spend.

    Utilities are taken in per cent of the peak. noise is the median of those up to the median and k scaled deviations, at least 1; a pool of one row has
    one leader. Medians are those of a query's pool.
    """
    u = pool.select(query, F.greatest(F.col(utility), F.lit(1e-9)).alias("u"))
    u = u.join(u.groupBy(query).agg(F.max("u").alias("peak"), F.percentile("u", 0.5).alias("mid"), F.count("*").alias("n")), query).withColumn("g", 100.0 * F.col("u") / F.col("peak"))
    weak = F.when(F.col("u") <= F.col("mid"), F.col("g"))
    u = u.join(u.groupBy(query).agg(F.percentile(weak, 0.5).alias("med")), query).withColumn("off", F.when(F.col("u") <= F.col("mid"), F.abs(F.col("g") - F.col("med"))))
    u = u.join(u.groupBy(query).agg(F.percentile("off", 0.5).alias("mad")), query)
    noise = F.when(F.col("n") <= 1, 1.0).otherwise(F.greatest(F.lit(1.0), F.col("med") + k * 1.4826 * F.col("mad")))
    u = u.withColumn("noise", noise)
    g = u.groupBy(query).agg(F.max("noise").alias("noise"), F.greatest(F.lit(1), F.count(F.when((F.col("g") > F.col("noise")) & (F.col("n") > 1), 1))).alias("leaders"))
    return g.withColumn("step_limit", F.greatest(F.lit(1), F.floor(budget / F.col("leaders"))).cast("bigint"))


#: Seeds of a role, extra exact hits of a role, and the most extra roles and families of channels that raise a score.
ROLE_CAP, EXACT_RESERVE, MOST_EXTRA = 7, 1, 2


def pick_seeds(rows: list[dict], intents: list[str], anchors: frozenset[str], cap: int = ROLE_CAP, reserve: int = EXACT_RESERVE, role_boost: float = 0.0, channel_boost: float = 0.0, exact_boost: float = 0.0) -> list[dict]:
    """Seeds of one query from the candidates of its roles: dicts of uid, roles, reasons, score, in the order they were admitted.

    ``rows``: role, place, uid, exact, channels, score. Roles take turns once, those asked for first, then by name. A role gets its first ``cap`` candidates; its
    anchors (candidates of a role in ``anchors``) are never dropped and may overflow the cap, and a role without an exact hit so far keeps up to ``reserve`` of
    its own in place of ranked ones. What several roles offer is one seed with all their evidence.
    """
    by_role: dict[str, list[str]] = {}
    about: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["place"], r["uid"])):
        keys = by_role.setdefault(r["role"], [])
        if r["uid"] not in keys:
            keys.append(r["uid"])
    order = [r for r in dict.fromkeys(intents) if r in by_role] + sorted(set(by_role) - set(intents))
    turn = {r: i for i, r in enumerate(order)}
    for r in sorted(rows, key=lambda r: (turn[r["role"]], r["place"], r["uid"])):
        a = about.setdefault(r["uid"], {"uid": r["uid"], "roles": [], "exact": set(), "channels": set(), "score": r["score"]})
        if r["role"] not in a["roles"]:
            a["roles"].append(r["role"])
        a["channels"] |= set(r["channels"])
        a["score"] = max(a["score"], r["score"])
        if r["exact"]:
            a["exact"].add(r["role"])
    anchored = {u for u, a in about.items() if anchors & set(a["roles"])}
    chosen: dict[str, str] = {}
    for role in order:
        keys = by_role[role]
        first = set(keys[:cap])
        hard = [u for u in keys if u in anchored]
        if not any(role in about[u]["exact"] for u in first | set(chosen)):
            hard += [u for u in keys if role in about[u]["exact"] and u not in anchored and u not in chosen and u not in first][:reserve]
        hard = [u for u in hard if u not in chosen]
        mine = hard + [u for u in keys if u not in hard][: max(0, max(cap, len(hard)) - len(hard))]
        for u in mine:
            chosen.setdefault(u, "hard_reserve" if u in hard else "ranked_fill")
    out = []
    for u, why in chosen.items():
        a = about[u]
        bonus = role_boost * min(MOST_EXTRA, len(a["roles"]) - 1) + channel_boost * min(MOST_EXTRA, max(0, len(a["channels"]) - 1)) + (exact_boost if a["exact"] else 0.0)
        reasons = [n for n, c in (("explicit_anchor", u in anchored), ("exact_symbol", a["exact"]), ("multi_intent_role", len(set(a["roles"]) & set(intents)) >= 2), ("multi_channel", len(a["channels"]) >= 2)) if c]
        out.append({"uid": u, "roles": a["roles"], "reasons": [*reasons, why], "score": min(1.0, a["score"] + bonus)})
    return out


def select_seeds(candidates: DataFrame, query: str, intents: list[str], anchors: frozenset[str] = frozenset(), **how) -> DataFrame:
    """``query, place, uid, roles, reasons, score`` of pick_seeds() for each query. ``candidates``: the query, role, place, uid, exact, channels, score; without role or uid a row is left out.

    A query's candidates are a bounded number for each role, as an earlier top-k left them.
    """
    kind = dict(candidates.dtypes)[query]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        got = pick_seeds(pdf.to_dict("records"), intents, anchors, **how)
        return pd.DataFrame({query: [pdf[query].iloc[0]] * len(got), "place": range(1, len(got) + 1)} | {c: pd.Series([g[c] for g in got], dtype=object) for c in ("uid", "roles", "reasons")} | {"score": [float(g["score"]) for g in got]})

    c = candidates.where("role is not null and uid is not null").select(query, "role", "place", "uid", "exact", F.coalesce("channels", F.array().cast("array<string>")).alias("channels"), F.coalesce("score", F.lit(0.0)).alias("score"))
    return deal(c, query).groupBy(query).applyInPandas(one, f"{query} {kind}, place int, uid string, roles array<string>, reasons array<string>, score double")


def render(code: Column, rung: str) -> Column:
    """A symbol's text at a rung of the ladder: signature_only, fold (declarations and their indentation) or full."""
    lines = F.split(code, "\n")
    declares = r"^\s*(async def|def|class|func|function|fn|public|private|protected|export|interface|type|@)"
    if rung == "full":
        return code
    if rung == "signature_only":
        return F.element_at(lines, 1)
    return F.array_join(F.transform(lines, lambda s, i: F.when((i == 0) | s.rlike(declares) | s.rlike(r"^\s*(return|raise|yield)\b"), s).otherwise(F.lit(None).cast("string"))), "\n")
