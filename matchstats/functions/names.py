"""Team names: dictionary lookup, nicknames, codes, and substring matches within a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchstats.sources.folders import written

#: Cities taken out of a name before its last word is the nickname.
CITIES = (
    "los angeles", "new york", "golden state", "oklahoma city", "san antonio", "new orleans", "portland", "phoenix", "miami", "boston", "chicago",
    "cleveland", "dallas", "denver", "detroit", "houston", "indiana", "milwaukee", "minnesota", "memphis", "orlando", "philadelphia", "sacramento",
    "toronto", "utah", "washington", "atlanta", "brooklyn", "charlotte", "la ", "ny ",
)
#: Nickname and code, in the order in which they are tried.
CODES = {
    "lakers": "lal", "celtics": "bos", "warriors": "gsw", "nets": "bkn", "knicks": "nyk", "bulls": "chi", "cavaliers": "cle", "mavericks": "dal",
    "nuggets": "den", "pistons": "det", "rockets": "hou", "pacers": "ind", "clippers": "lac", "heat": "mia", "bucks": "mil", "timberwolves": "min",
    "pelicans": "nop", "thunder": "okc", "magic": "orl", "76ers": "phi", "suns": "phx", "blazers": "por", "kings": "sac", "spurs": "sas",
    "raptors": "tor", "jazz": "uta", "wizards": "was", "hawks": "atl", "hornets": "cha", "grizzlies": "mem", "sixers": "phi", "trail blazers": "por",
}


def _variants(teams: DataFrame) -> DataFrame:
    """The teams once for each text that means them, as _key."""
    full = F.lower(F.trim("full_name"))
    variants = F.array(full, F.lower(F.trim("abbreviation")), F.regexp_replace(full, "^los angeles ", "la "), F.regexp_replace(full, "^la ", "los angeles "))
    return teams.withColumn("_key", F.explode(F.array_distinct(variants)))


def normalize_team(df: DataFrame, column: str, teams: DataFrame, out: str = "team_id") -> DataFrame:
    """Adds `out`: the team_id whose full name, abbreviation or "LA" / "Los Angeles" variant the name is, in any case and
    without outer blanks; null if there is none.  Of several teams the smallest id is taken."""
    lookup = _variants(teams).groupBy("_key").agg(F.min("team_id").alias(out))
    return df.withColumn("_key", F.lower(F.trim(column))).join(lookup, "_key", "left").drop("_key")


def grams(name: Column) -> Column:
    """All runs of one to three characters of a text."""
    at = lambda k: F.when(F.length(name) >= k, F.transform(F.sequence(F.lit(1), F.length(name) - (k - 1)), lambda i: F.substring(name, i, F.lit(k))))
    return F.array_distinct(F.flatten(F.filter(F.array(*[at(k) for k in (1, 2, 3)]), lambda x: x.isNotNull())))


def meetings(left: DataFrame, a: str, right: DataFrame, b: str, on: list[str] = []) -> DataFrame:  # noqa: B006
    """(on, a, b, _held): the distinct texts of left and right (equal in `on`) that meet at a rare part, where _held is the
    one that picked it and so may be held by the other.

    A text that holds another has all its runs of three characters (or the whole of a shorter text).  So each text asks at that
    one of its runs which the fewest texts of the other side have, and no common beginning brings all with all together.
    """
    some = lambda df, c, other: df.where(F.length(c) > 0).select(*on, F.col(c).alias("_text"), F.lit(other).alias("_left")).distinct()
    parts = some(left, a, True).unionByName(some(right, b, False)).withColumn("_gram", F.explode(grams(F.col("_text"))))
    counts = parts.groupBy(*on, "_gram").agg(F.count_if("_left").alias("_nl"), F.count_if(~F.col("_left")).alias("_nr"))
    asked = parts.where(F.length("_gram") == F.least(F.length("_text"), F.lit(3))).join(counts, [*on, "_gram"])
    asked = asked.withColumn("_n", F.when(F.col("_left"), F.col("_nr")).otherwise(F.col("_nl")))
    rarest = asked.groupBy(*on, "_text", "_left").agg(F.min(F.struct("_n", "_gram")).alias("_r")).where("_r._n > 0")
    rarest = rarest.select(*on, F.col("_r._gram").alias("_gram"), F.col("_text").alias("_held"), F.col("_left").alias("_from_left"))
    met = rarest.join(parts, [*on, "_gram"]).where(F.col("_from_left") != F.col("_left"))
    sides = F.when(F.col("_from_left"), F.struct(F.col("_held").alias(a), F.col("_text").alias(b))).otherwise(F.struct(F.col("_text").alias(a), F.col("_held").alias(b)))
    return met.select(*on, "_held", sides.alias("_s")).select(*on, "_s.*", "_held")


#: Texts of more characters are not taken apart into all their pieces.
LONG = 64


def _known(texts: DataFrame, column: str) -> tuple[int, int, str | None]:
    """Lengths of the shortest and the longest text, and the characters that texts begin with (None: too many to list)."""
    text = F.col(column)
    begins = F.substring(text, F.lit(1), F.lit(1))
    low, high, n = texts.where(F.length(text) > 0).agg(F.min(F.length(text)), F.max(F.length(text)), F.approx_count_distinct(begins)).first()
    few = texts.where(F.length(text) > 0).select(begins).distinct().limit(501).collect() if low and n < 500 else []  # characters, at most 501
    return low or 0, high or 0, "".join(r[0] for r in few) if 0 < len(few) <= 500 else None


def pieces(text: Column, low: int, high: int, begins: str | None) -> Column:
    """All distinct pieces of a text that have low to high characters and begin with one of the given ones."""
    most = lambda i: F.least(F.lit(high), F.length(text) - i + 1)
    own = lambda i: F.transform(F.sequence(F.lit(low), most(i)), lambda k: F.substring(text, i, k))
    fits = lambda i: (most(i) >= low) & (F.lit(True) if begins is None else F.contains(F.lit(begins), F.substring(text, i, F.lit(1))))
    starts = F.filter(F.sequence(F.lit(1), F.length(text)), fits)
    return F.array_distinct(F.flatten(F.transform(starts, own)))


def contained(left: DataFrame, a: str, right: DataFrame, b: str, on: list[str] = [], among: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """(on, a, b): the distinct texts of left and right (equal in `on`) of which one holds the other.  A pair may come twice;
    empty and null texts match nothing.

    A text holds another if one of its pieces equals it, so pieces of the lengths and beginnings that the other side has are
    joined with its texts, and nothing meets in vain.  Texts longer than LONG meet the others at rare parts.  `among`: rows that
    are at hand and have all of left's texts, for its lengths and beginnings.
    """
    known = {a: _known(left if among is None else among, a), b: _known(right, b)}
    texts = {c: df.where(F.length(c) > 0).select(*on, c).distinct() for df, c in ((left, a), (right, b))}
    out = None
    for holder, held in ((a, b), (b, a)):
        low, high, begins = known[held]
        if not low:
            continue
        some = texts[holder].where(F.length(holder) <= LONG)
        met = some.withColumn(held, F.explode(pieces(F.col(holder), low, high, begins))).join(texts[held].hint("merge"), [*on, held]).select(*on, a, b)
        out = met if out is None else out.unionByName(met)
        if known[holder][1] > LONG:
            sides = {c: texts[c].where(F.length(c) > LONG) if c == holder else texts[c] for c in (a, b)}
            found = meetings(sides[a], a, sides[b], b, on)
            out = out.unionByName(found.where(F.contains(F.when(F.col(a) == F.col("_held"), F.col(b)).otherwise(F.col(a)), F.col("_held"))).drop("_held"))
    return texts[a].join(texts[b].where("false"), on) if on and out is None else texts[a].crossJoin(texts[b].where("false")) if out is None else out


def resolve_names(df: DataFrame, column: str, teams: DataFrame) -> DataFrame:
    """Adds full_name and abbreviation of the team that a name means: by normalize_team(), else of a team whose full name
    holds the name or is held by it (the first full name by the alphabet); a name that means no team stands in both as it
    is.  Each distinct name is looked up once."""
    team = F.struct("full_name", "abbreviation")
    own = df.select(F.col(column).alias("_name")).distinct().where("_name is not null").withColumn("_low", F.lower(F.trim("_name")))
    lookup = _variants(teams.select("team_id", team.alias("_team"), "full_name", "abbreviation")).groupBy("_key").agg(F.min_by("_team", "team_id").alias("_exact"))
    own = own.join(lookup.withColumnRenamed("_key", "_low"), "_low", "left")
    full = teams.select(F.lower(F.trim("full_name")).alias("_full"), team.alias("_team")).groupBy("_full").agg(F.min("_team").alias("_team"))
    near = contained(own.where("_exact is null"), "_low", full, "_full", [], own).join(full, "_full").groupBy("_low").agg(F.min("_team").alias("_near"))
    means = own.join(near, "_low", "left").select("_name", F.coalesce("_exact", "_near").alias("_team"))
    out = df.join(means, df[column] == F.col("_name"), "left")
    return out.select(*[df[c] for c in df.columns], *[F.coalesce(F.col(f"_team.{c}"), df[column]).alias(c) for c in ("full_name", "abbreviation")])


def nickname(name: Column) -> Column:
    """The last word of a lower-cased name without its city; an empty text if nothing is left."""
    c = F.lower(name)
    for city in CITIES:
        c = F.replace(c, F.lit(city), F.lit(""))
    return F.when(F.trim(c) == "", "").otherwise(F.element_at(F.split(F.trim(c), r"\s+"), -1))


def keyword_code(name: Column) -> Column:
    """The code of the first known nickname in a name; without any, the shortened name itself."""
    c = F.lower(F.trim(name))
    for long, short in (("los angeles", "la"), ("new york", "ny"), ("golden state", "gs")):
        c = F.replace(c, F.lit(long), F.lit(short))
    return F.coalesce(*[F.when(F.contains(c, F.lit(n)), F.lit(code)) for n, code in CODES.items()], c)


def fuzzy_match(left: DataFrame, right: DataFrame, key: str, on: str = "game_date", swapped: bool = False) -> DataFrame:
    """Left rows (id column `key`, home, away) with right_id: an equal (date, home, away) row of right (id, home, away),
    else the one of smallest id on the date whose names contain, or are contained in, both names.

    With `swapped` a row of right may also have the two teams the other way round, equal names before similar ones.  The
    substring join runs only over left rows that the equality join missed, within a date and by the rarer of the two names.
    """
    right = right.select(on, F.col("id").alias("right_id"), F.lower(F.trim("home")).alias("_h"), F.lower(F.trim("away")).alias("_a"))
    if swapped:
        right = right.unionByName(right.select(on, "right_id", F.col("_a").alias("_h"), F.col("_h").alias("_a")))
    left = left.withColumns({"_lh": F.lower(F.trim("home")), "_la": F.lower(F.trim("away"))})
    equal = left.join(right.withColumnsRenamed({"_h": "_lh", "_a": "_la"}), [on, "_lh", "_la"]).groupBy(key).agg(F.min("right_id").alias("right_id"))
    rest = left.join(equal, key, "left_anti")
    # A pair needs both names: each left row takes those of its names that fewer right rows share.
    rows = written(rest.select(key, on, "_lh", "_la"), "names-asked")
    asked, pairs = rows, {}
    for own, other, size in (("_lh", "_h", "_nh"), ("_la", "_a", "_na")):
        pairs[other] = written(contained(asked, own, right, other, [on], asked).distinct(), "name-pairs")
        counts = right.groupBy(on, other).agg(F.count("*").alias("n"))
        size_of = pairs[other].join(counts, [on, other]).groupBy(on, own).agg(F.sum("n").alias(size))
        rows = rows.join(size_of, [on, own])  # without any for one name there is none for both
    holds = lambda x, y: F.contains(x, y) | F.contains(y, x)
    by_home = rows.where("_nh <= _na").join(pairs["_h"], [on, "_lh"]).join(right, [on, "_h"]).where(holds(F.col("_la"), F.col("_a")))
    by_away = rows.where("_nh > _na").join(pairs["_a"], [on, "_la"]).join(right, [on, "_a"]).where(holds(F.col("_lh"), F.col("_h")))
    fuzzy = by_home.select(key, "right_id").unionByName(by_away.select(key, "right_id")).groupBy(key).agg(F.min("right_id").alias("right_id"))
    return left.drop("_lh", "_la").join(equal.unionByName(fuzzy), key, "left")
