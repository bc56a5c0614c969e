"""Variant spellings of names linked by partitioning a metric space.

A name becomes a point (main part, second part): surname and given name of a
person, distinctive word and other words of a firm (:mod:`tidemark.llm.name_forms`
puts order, titles, short forms and abbreviations right).  Distance is the sum of
the parts' Damerau-Levenshtein distances, a true metric.  The most frequent second
parts are the pivots, each the centre of a cell; a point lies at home in the cell
of its nearest pivot.

By the triangle inequality a pair within ``radius`` meets in the home cell of that
one of the two which is nearer to its pivot if every point is also copied to all
pivots at most its own home distance plus ``radius`` away: with y at home in p,
d(x, p) <= d(x, y) + d(y, p) <= radius + d(x, home of x).  Inside each cell an exact
radius join runs on the points; two points copied from elsewhere aren't compared.

A cell with more than ``crowd`` points is split again in the same way by pivots among its
main parts, whose distance is bounded by the radius as well, and again until it is small
``LEVELS`` splits are done, or a split saves less than half of the pairs to compare (among names that
all lie far apart none does).  What is still large is cut into blocks of ``block`` points, and
the pairs of blocks are spread over the cluster; nothing is dropped.  Points of one cell are
compared if, at each split, one of them is at home.  Equal points are one point, expanded
to ids at the end, because every pair is asked for; of more than ``expand`` equally written
names the smallest id stands for all (``name_classes`` has the members).

A name with an initial only is linked to full names of its surname if they all are
of one person; where several persons fit, it is linked to none of them (it can't be
told which), only to like names.

Defined results: rows with a null id, null or empty name, or a type other than
person and organisation give nothing; ids with two names are linked through either.
Repeated rows change nothing.  An empty table gives an empty result; extra columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bbit_minhash import expand_classes, standing_ids
from tidemark.llm.given_names import GIVEN_NAMES
from tidemark.llm.name_forms import ABBREVIATIONS, entity_kind, name_forms
from tidemark.sources.tables import materialise, shuffle_partitions

#: Pivots of each space, and of each cell that is split: bounded numbers, whatever the size of the table.
PIVOTS, INNER = 400, 48
#: Most splits of a cell.
LEVELS = 4
_POINT = "space string, main string, second string"
_KNOWN_WORDS = frozenset(ABBREVIATIONS.values())


def edit_distance(a: str, b: str, most: int) -> int:
    """The unrestricted Damerau-Levenshtein distance (a metric), or ``most + 1`` if it is more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    n, far = len(b), len(a) + len(b)
    last: dict[str, int] = {}
    rows = [[far] * (n + 2), [far, *range(n + 1)]]
    for i, x in enumerate(a, 1):
        row = [far, i]
        match = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            cost = 1
            if x == y:
                cost, match = 0, j
            row.append(min(rows[i][j] + cost, row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1)))
        last[x] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def letters(word: str) -> int:
    """The set of a word's letters as bits; an edit changes at most two of them."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) % 61)
    return bits


def points(df: DataFrame, id_col: str, name_col: str, type_col: str) -> DataFrame:
    """``id``, the points of its name and ``copy`` (hash of the name as written), distinct."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (own, *form, xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass")) - (1 << 63))
                for own, name, kind in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
                if name and (known := entity_kind(kind))
                for form in name_forms(known, name)
            ]
            types = [pa.string()] * 4 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=["id", "space", "main", "second", "copy"])

    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(name_col).cast("string").alias("name"), F.col(type_col).cast("string").alias("kind")).where("id is not null and name is not null")
    return rows.mapInArrow(run, f"id string, {_POINT}, copy long").distinct()


def _near(word: str, pivots: list[str], bags: np.ndarray, radius: int) -> tuple[int, list[int]]:
    """The nearest pivot, and all pivots at most ``radius`` farther than it."""
    # half the differing letters bound the distance from below
    least = (np.bitwise_count(bags ^ np.uint64(letters(word))) + 1) // 2
    home, best, found = -1, 1 << 30, []
    for k in np.argsort(least, kind="stable").tolist():
        if least[k] > best + radius:
            break
        d = edit_distance(word, pivots[k], min(best + radius, 64))
        found.append((d, k))
        if d < best:
            home, best = k, d
    return home, [k for d, k in found if d <= best + radius]


def _cells(keys: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    """The points with the cells they lie in: ``cell``, ``home`` (1 if it is their own, else 0), ``splits`` (0)."""
    counts = keys.where("space in ('person', 'organization')").groupBy("space", "second").count()
    pivots: dict[str, list[str]] = {}
    for space in ("person", "organization"):
        top = counts.where(F.col("space") == space).orderBy(F.desc("count"), "second").limit(n_pivots).collect()
        pivots[space] = [r.second for r in top]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[tuple[str, int]]] = {}
        bags = {space: np.array([letters(p) for p in own], np.uint64) for space, own in pivots.items()}

        def cells_of(space: str, second: str) -> list[tuple[str, int]]:
            if space not in pivots:  # an initial is its own cell
                return [(f"initial:{second}", 1)]
            home, near = _near(second, pivots[space], bags[space], radius)
            return [(f"{space}:{pivots[space][k]}", int(k == home)) for k in near]

        for batch in batches:
            out = []
            for space, main, second in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if (space, second) not in known:
                    if len(known) > 200_000:
                        known.clear()
                    known[space, second] = cells_of(space, second)
                out += [(space, main, second, cell, home, 0) for cell, home in known[space, second]]
            yield _rows(out)

    return keys.select("space", "main", "second").mapInArrow(run, _CELL)


_CELL = f"{_POINT}, cell string, home int, splits int"
_CELL_TYPES = [pa.string()] * 4 + [pa.int32()] * 2


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_CELL_TYPES)], names=["space", "main", "second", "cell", "home", "splits"])


def far_apart(names: list[str], least: int, most: int) -> list[str]:
    """Names farther than ``least`` from each other, ``most`` at most, so that a knot of like names has one pivot."""
    out: list[str] = []
    for name in names:
        if len(out) == most:
            break
        if all(edit_distance(name, other, least) > least for other in out):
            out.append(name)
    return out


def _split(cells: DataFrame, crowded: DataFrame, radius: int, n_pivots: int) -> DataFrame:
    """The points of crowded cells in cells around pivots among the main parts; bit k of ``home`` is the k-th split's."""
    mains = cells.join(crowded, "cell", "left_semi").select("cell", "main").distinct()
    w = Window.partitionBy("cell").orderBy(F.xxhash64("main"), "main")
    some = mains.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= 8 * n_pivots)

    @F.pandas_udf("array<string>")
    def apart(lists: pd.Series) -> pd.Series:
        return lists.map(lambda names: far_apart(list(names), 2 * radius, n_pivots))

    chosen = some.groupBy("cell").agg(F.sort_array(F.collect_list("main")).alias("some"))  # 8 * n_pivots at most
    chosen = materialise(chosen.select("cell", apart("some").alias("pivots")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[str, np.ndarray] = {}
        for batch in batches:
            out = []
            for space, main, second, cell, home, splits, pivots in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if cell not in bags:
                    if len(bags) > 1000:
                        bags.clear()
                    bags[cell] = np.array([letters(p) for p in pivots], np.uint64)
                own, near = _near(main, pivots, bags[cell], radius)
                out += [(space, main, second, f"{cell}/{pivots[k]}", home | int(k == own) << splits + 1, splits + 1) for k in near]
            yield _rows(out)

    return cells.join(chosen, "cell").select("space", "main", "second", "cell", "home", "splits", "pivots").mapInArrow(run, _CELL)


def placed_points(keys: DataFrame, radius: int, n_pivots: int = PIVOTS, crowd: int = 20_000, inner: int = INNER) -> DataFrame:
    """The points in their cells, crowded ones split: ``cell``, ``home``, ``splits``."""
    todo, done = materialise(_cells(keys, radius, n_pivots)), None

    def put_aside(rows: DataFrame) -> None:
        nonlocal done
        done = rows.select(*todo.columns) if done is None else done.unionByName(rows.select(*todo.columns))

    for _ in range(LEVELS):
        sizes = todo.groupBy("cell").count().where(F.col("count") > crowd)
        crowded = materialise(sizes.select("cell", (F.col("count") * F.col("count")).alias("pairs")))
        if crowded.isEmpty():
            break
        put_aside(todo.join(crowded, "cell", "left_anti"))
        split = materialise(_split(todo, crowded, radius, inner))
        parent = F.expr("substring(cell, 1, length(cell) - length(regexp_extract(cell, '[^/]*$', 0)) - 1)")
        within = split.groupBy("cell").count().groupBy(parent.alias("cell")).agg(F.sum(F.col("count") * F.col("count")).alias("left"))
        # names that lie far from each other lie near no pivot either: a split that saves no work is not taken
        kept = materialise(crowded.join(within, "cell").where(F.col("left") < 0.5 * F.col("pairs")).select("cell"))
        put_aside(todo.join(crowded, "cell", "left_semi").join(kept, "cell", "left_anti"))
        todo = split.withColumn("_up", parent).join(kept.select(F.col("cell").alias("_up")), "_up", "left_semi").select(*todo.columns)
        todo = materialise(todo)
    return todo if done is None else done.unionByName(todo)


def same_name(a: tuple[str, str, str], b: tuple[str, str, str], radius: int) -> bool:
    """Whether two points name the same, by the metric and what is known of given names and firms' words."""
    main = edit_distance(a[1], b[1], radius)
    if main > radius:
        return False
    if a[2] == b[2]:
        # two slips in one short word would be another word
        return main == 0 or (main == 1 and min(len(a[1]), len(b[1])) >= 4) or min(len(a[1]), len(b[1])) >= 7
    if a[0] not in ("person", "organization"):
        return False
    if main + edit_distance(a[2], b[2], radius - main) > radius:
        return False
    if a[0] == "person":
        return not (a[2] in GIVEN_NAMES and b[2] in GIVEN_NAMES)
    x, y = a[2].split(), b[2].split()
    return len(x) == len(y) and not any(p != q and p in _KNOWN_WORDS and q in _KNOWN_WORDS for p, q in zip(x, y, strict=True))


def _cell_join(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = pdf[pdf["side"] != "right"].drop_duplicates(["space", "main", "second"])
        right = pdf[pdf["side"] != "left"].drop_duplicates(["space", "main", "second"])
        one_block = pdf["side"].iloc[0] == "both"
        every = (2 << int(pdf["splits"].iloc[0])) - 1  # at each split one of the two is at home
        right = right.assign(size=right["main"].str.len()).sort_values("size", kind="stable").reset_index(drop=True)
        size = right["size"].to_numpy()
        bag = np.array([letters(m) for m in right["main"]], np.uint64)
        home = right["home"].to_numpy(np.int64)
        typed = right["space"].to_numpy() == "initial"
        given = np.array([s in GIVEN_NAMES for s in right["second"]]) & (right["space"].to_numpy() == "person")
        rows = list(zip(right["space"], right["main"], right["second"], strict=True))
        out = []
        for *a, own in zip(left["space"], left["main"], left["second"], left["home"], strict=True):
            a = tuple(a)
            lo, hi = np.searchsorted(size, [len(a[1]) - radius, len(a[1]) + radius + 1])
            ok = np.bitwise_count(bag[lo:hi] ^ np.uint64(letters(a[1]))) <= 2 * radius
            if own != every:
                ok &= (home[lo:hi] | own) == every
            if a[0] == "expanded":
                ok &= typed[lo:hi]
            if not own & 1 and a[0] == "person" and a[2] in GIVEN_NAMES:
                ok &= ~given[lo:hi]  # another known given name at home here is another person
            for k in (np.flatnonzero(ok) + lo).tolist():
                b = rows[k]
                if (a < b or not one_block) and a != b and same_name(a, b, radius):
                    out.append((*min(a, b), *max(a, b)))
        return pd.DataFrame(out, columns=["space_a", "main_a", "second_a", "space_b", "main_b", "second_b"], dtype=object)

    return run


def near_points(keys: DataFrame, radius: int, block: int, n_pivots: int = PIVOTS, crowd: int = 20_000, inner: int = INNER) -> DataFrame:
    """Distinct pairs of points that name the same."""
    cells = materialise(placed_points(keys, radius, n_pivots, crowd, inner))
    sizes = materialise(cells.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")))
    placed = cells.join(sizes, "cell").withColumn("block", F.pmod(F.xxhash64("main", "second", "space"), F.col("blocks")).cast("int"))
    # a point of block i goes to every pair of blocks with i; almost all cells have one block
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    side = F.when(F.col("block") == F.col("other"), "both").when(F.col("block") < F.col("other"), "left").otherwise("right")
    tasks = spread.select("space", "main", "second", "home", "splits", "cell", i.alias("i"), j.alias("j"), side.alias("side"))
    # little data, much work: as many partitions as there are for much data, and more with the pairs of blocks
    n_pairs = sizes.agg(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2)).first()[0] or 0
    n = max(4 * shuffle_partitions(keys.sparkSession), int(n_pairs) // 8)
    schema = "space_a string, main_a string, second_a string, space_b string, main_b string, second_b string"
    return tasks.repartition(n, "cell", "i", "j").groupBy("cell", "i", "j").applyInPandas(_cell_join(radius), schema).distinct()


def linked_names(df: DataFrame, id_col: str = "id", name_col: str = "name", type_col: str = "entity_type", radius: int = 2, block: int = 4000, expand: int = 1000, pivots: int = PIVOTS) -> DataFrame:
    """``id_a`` < ``id_b`` of every two ids that name the same person, or the same organisation.

    More than ``expand`` ids of one and the same written name are linked through the smallest of
    them, which also stands for them in links to other names, instead of in all pairs.
    """
    forms = materialise(points(df, id_col, name_col, type_col))
    key = ["space", "main", "second"]
    near = materialise(near_points(forms.select(*key).distinct(), radius, block, pivots))
    full = near.where("space_a <> 'expanded' and space_b <> 'expanded'")

    # an initial meets full names: those of its own point, and near ones; all between points, not ids
    lone = forms.where("space = 'initial'").select("main", "second").distinct()
    own = forms.where("space = 'expanded'").select("main", "second").distinct().join(lone, ["main", "second"], "left_semi")
    exact = own.select(F.lit("expanded").alias("space_a"), F.col("main").alias("main_a"), F.col("second").alias("second_a"), F.lit("initial").alias("space_b"), F.col("main").alias("main_b"), F.col("second").alias("second_b"))
    mixed = near.where("space_a = 'expanded' and space_b = 'initial'").unionByName(exact)
    # who the full names are: their given names, slips aside
    given = forms.where("space = 'person'").select("id", F.col("second").alias("given")).where(F.col("given").isin(*sorted(GIVEN_NAMES)))
    bearers = forms.where("space = 'expanded'").join(given, "id").select(F.col("main").alias("main_a"), F.col("second").alias("second_a"), "given").where(F.col("given").startswith(F.col("second_a"))).distinct()
    several = mixed.join(bearers, ["main_a", "second_a"]).groupBy("main_b", "second_b").agg(F.count_distinct("given").alias("n")).where("n > 1").select("main_b", "second_b")
    told = mixed.join(several, ["main_b", "second_b"], "left_anti").select(*near.columns)
    # full names of one initial are one class only for names with that initial: links among them come from their own points
    paired = expand_classes(forms.where("space <> 'expanded'"), key, full, expand)

    def standing(space: str, name: str, side: str) -> DataFrame:
        own = standing_ids(forms.where(F.col("space") == space).select("id", "main", "second", "copy"), ["main", "second"], expand).where("stands")
        return own.select(F.col("id").alias(name), F.col("main").alias(f"main_{side}"), F.col("second").alias(f"second_{side}")).distinct()

    few, many = standing("initial", "two", "b"), standing("expanded", "one", "a")
    linked = told.join(few, ["main_b", "second_b"]).join(many, ["main_a", "second_a"]).where("one <> two")
    return paired.unionByName(linked.select(F.least("one", "two").alias("id_a"), F.greatest("one", "two").alias("id_b"))).distinct()


def name_classes(df: DataFrame, id_col: str = "id", name_col: str = "name", type_col: str = "entity_type", radius: int = 2, block: int = 4000, pivots: int = PIVOTS) -> DataFrame:
    """One row per id and form of its name: ``id``, ``kind``, ``class_id`` (names that are one point), ``copies``, ``links`` to other classes.

    Names with an initial only are classes of their own, linked to like ones; a short form that stands for
    several given names has a row for each.
    """
    forms = materialise(points(df, id_col, name_col, type_col).where("space <> 'expanded'"))
    key = ["space", "main", "second"]
    near = near_points(forms.select(*key).distinct(), radius, block, pivots)
    ends = near.select(*(F.col(f"{k}_a").alias(k) for k in key)).unionByName(near.select(*(F.col(f"{k}_b").alias(k) for k in key)))
    members = forms.select("id", *key).distinct()
    joined = members.join(members.groupBy(*key).agg(F.count("*").alias("copies")), key).join(ends.groupBy(*key).agg(F.count("*").alias("links")), key, "left")
    kind = F.when(F.col("space") == "organization", "organization").otherwise("person")
    return joined.select("id", kind.alias("kind"), F.xxhash64(*key).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
