"""Resolution of free names to components: patterns, exact aliases, and the longest alias that stands in a name."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Methods of the alias sources, in order of precedence, with their scores.
SOURCES = {"manual_alias": 100.0, "knowledge_alias": 100.0, "exact_translated": 98.0, "exact_master": 95.0}
#: Score of a pattern, and the most a contained alias can score.
PATTERN_SCORE, CONTAINED_MOST = 99.0, 90.0
#: Methods that need no word in common with the component's own name.
TRUSTED = ("manual_alias", "knowledge_alias")
#: Aliases of fewer characters aren't looked for inside names.
SHORTEST = 4
#: Aliases that one compiled trie may hold (some 300 bytes each); more are found by joins.
TRIE_ALIASES = 200_000

_ACCENTED, _PLAIN = "ÁÀÄÂÃÅÉÈËÊÍÌÏÎÓÒÖÔÕÚÙÜÛÑÇ", "AAAAAAEEEEIIIIOOOOOUUUUNC"


def name_key(c: Column) -> Column:
    """Upper case without accents and bracketed parts, other signs than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.translate(F.upper(F.coalesce(c, F.lit(""))), _ACCENTED, _PLAIN), r"\([^)]*\)", " "), "[^A-Z0-9]+", " "))


def core_key(c: Column, salts: Iterable[str]) -> Column:
    """The name without words of salts and forms, and without numbers."""
    drop = F.array(*map(F.lit, salts))
    return F.array_join(F.filter(F.split(name_key(c), " "), lambda w: ~F.array_contains(drop, w) & ~w.rlike("^[0-9]+$")), " ")


def alias_table(aliases: DataFrame) -> DataFrame:
    """(key, target, method, score, usable): one row per key, from the first source in SOURCES' order that has it, then the least place.

    aliases: alias, target, method, place, canonical (the target's own name). An alias is usable if its source is trusted or
    it shares a word of three letters with the canonical name; one from translations is looked for inside names anyway.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("method"))
    words = lambda c: F.filter(F.split(name_key(c), " "), lambda w: F.length(w) >= 3)
    known = aliases.withColumn("key", name_key(F.col("alias"))).filter((F.col("key") != "") & F.col("target").isNotNull() & (rank > 0))
    first = known.groupBy("key").agg(F.min_by(F.struct("target", "method", "canonical"), F.struct(rank.alias("r"), "place", "target")).alias("a")).select("key", "a.*")
    score = F.element_at(F.create_map(*[F.lit(x) for kv in SOURCES.items() for x in kv]), F.col("method"))
    return first.select("key", "target", "method", score.alias("score"), (F.col("method").isin(*TRUSTED) | F.arrays_overlap(words(F.col("key")), words(F.col("canonical")))).alias("usable"))


class AliasTrie:
    """Aliases as a trie over words, with failure links: all aliases that stand in a name, in one pass over its words.

    A node is an index; `best` is the longest alias (in characters, then the first in order) that ends at the node or at
    one of its failure links.
    """

    def __init__(self, keys: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.best: list[str | None] = [None]
        for key in keys:
            at = 0
            for word in key.split(" "):
                if word not in self.next[at]:
                    self.next[at][word] = len(self.next)
                    self.next.append({})
                    self.best.append(None)
                at = self.next[at][word]
            self.best[at] = key
        self.fail = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            at = queue.popleft()
            for word, child in self.next[at].items():
                self.fail[child] = self._step(self.fail[at], word)
                self.best[child] = _longer(self.best[child], self.best[self.fail[child]])
                queue.append(child)

    def _step(self, at: int, word: str) -> int:
        while at and word not in self.next[at]:
            at = self.fail[at]
        return self.next[at].get(word, 0)

    def longest(self, name: str) -> str | None:
        """The longest alias in the name between word borders; of equal ones the first by name."""
        at, found = 0, None
        for word in name.split(" "):
            at = self._step(at, word)
            found = _longer(found, self.best[at])
        return found


def _longer(a: str | None, b: str | None) -> str | None:
    if a is None or b is None:
        return a or b
    return a if (-len(a), a) <= (-len(b), b) else b


def contained_by_trie(names: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """(key, alias): the longest alias in each name. The aliases are compiled once and broadcast; their number is checked by the caller."""
    trie = names.sparkSession.sparkContext.broadcast(AliasTrie(sorted(r.key for r in aliases.select("key").collect())))

    @F.pandas_udf("string")
    def longest(keys):
        return keys.map(trie.value.longest)

    return names.select(key, longest(F.col(key)).alias("alias")).filter("alias IS NOT NULL")


def contained_by_join(names: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """The same by equality of word runs, for any number of aliases: a name asks with each run of as many words as some alias has."""
    lengths = [r.n for r in aliases.select(F.size(F.split("key", " ")).alias("n")).distinct().collect()]
    words, none = F.split(F.col(key), " "), F.array().cast("array<string>")

    def runs(n: int) -> Column:
        there = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, there).otherwise(none)

    asked = names.select(key, F.explode(F.array_distinct(F.concat(none, *map(runs, lengths)))).alias("alias"))
    hits = asked.join(aliases.select(F.col("key").alias("alias")), "alias")
    return hits.groupBy(key).agg(F.min(F.struct((-F.length("alias")).alias("l"), "alias"))["alias"].alias("alias"))


def resolved(names: DataFrame, name: str, aliases: DataFrame, patterns: list[tuple[str, str]], salts: Iterable[str] = (), salt_form: str | None = None, trie_aliases: int = TRIE_ALIASES) -> DataFrame:
    """names with target, method and score of each name.

    In this order: the first of `patterns` (regular expression, target) that the key matches, 99; a usable alias equal to
    the key, to its core, or to the salt form's core, with its source's score; the longest alias of four characters or
    more that stands in the key, 90 at most; else `unmapped`, 0. aliases: of `alias_table`. Distinct keys are resolved
    once. The trie is broadcast if there are at most `trie_aliases` aliases, else word runs are joined.
    """
    salts = tuple(salts)
    form = core_key(F.col(salt_form), salts) if salt_form else F.lit("")
    own = names.withColumn("_full", name_key(F.col(name))).withColumn("_core", core_key(F.col(name), salts)).withColumn("_form", form)
    keys = own.select("_full", "_core", "_form").distinct()
    pattern = F.lit(None).cast("string")
    for expression, target in reversed(patterns):
        pattern = F.when(F.concat(F.lit(" "), F.col("_full"), F.lit(" ")).rlike(expression), F.lit(target)).otherwise(pattern)
    asked = keys.select("*", F.posexplode(F.array("_full", "_core", "_form")).alias("_at", "key")).filter("key != ''")
    exact = asked.join(aliases.filter("usable"), "key").groupBy("_full", "_core", "_form").agg(F.min_by(F.struct("target", "method", "score"), "_at").alias("_exact"))
    inside = aliases.filter((F.length("key") >= SHORTEST) & (F.col("usable") | (F.col("method") == "exact_translated")))
    whole = keys.select("_full").distinct().filter("_full != ''")
    few = inside.limit(trie_aliases + 1).count() <= trie_aliases
    found = (contained_by_trie if few else contained_by_join)(whole, "_full", inside)
    held = found.join(inside.select(F.col("key").alias("alias"), F.struct("target", F.lit("contains_alias").alias("method"), F.least("score", F.lit(CONTAINED_MOST)).alias("score")).alias("_held")), "alias").select("_full", "_held")
    kind = "struct<target:string,method:string,score:double>"
    first = F.when(pattern.isNotNull(), F.struct(pattern.alias("target"), F.lit("nutrient_pattern").alias("method"), F.lit(PATTERN_SCORE).alias("score")).cast(kind))
    none = F.struct(F.lit("").alias("target"), F.lit("unmapped").alias("method"), F.lit(0.0).alias("score")).cast(kind)
    done = keys.join(exact, ["_full", "_core", "_form"], "left").join(held, "_full", "left")
    done = done.select("_full", "_core", "_form", F.coalesce(first, F.col("_exact").cast(kind), F.col("_held").cast(kind), none).alias("_r"))
    return own.join(done, ["_full", "_core", "_form"]).select(*names.columns, "_r.target", "_r.method", "_r.score")
