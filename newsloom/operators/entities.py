"""Entity resolution: forms, decision gates, registry, aliases, duplicates, back-fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions import text as t
from newsloom.operators.components import connected_components
from newsloom.sources.scratch import materialise

#: Thresholds of the gates and of reuse by type.
AUTOLINK, REVIEW, OTHER = 0.85, 0.70, 0.70
REUSE = {"ORG": 0.85, "LAW": 0.75, "POLICY": 0.70, "PROGRAM": 0.70, "EVENT": 0.80}


#: Ids in a block of members of a class.
BLOCK = 1024


def threshold(kind: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in REUSE.items() for v in pair])
    return F.coalesce(F.element_at(table, kind), F.lit(OTHER))


def gather_forms(mentions: DataFrame, terminal: DataFrame, aliases: DataFrame) -> DataFrame:
    """Distinct (surface_norm, type) of mentions (surface, type, sample) that are neither settled nor known.

    terminal: surface_norm, type. aliases: alias_norm, type. Grouping combines map-side first; both
    anti joins are equi-joins on the pair. The sample is the smallest id.
    """
    rows = mentions.filter("surface is not null and surface <> '' and type is not null")
    forms = rows.groupBy("surface", "type").agg(F.min("sample").alias("sample"))
    forms = forms.groupBy(t.normalize("surface").alias("surface_norm"), "type").agg(F.min("sample").alias("sample_unique_id")).filter("surface_norm <> ''")
    known = aliases.select(F.col("alias_norm").alias("surface_norm"), "type").unionByName(terminal.select("surface_norm", "type"))
    return forms.join(known, ["surface_norm", "type"], "left_anti").withColumn("status", F.lit("pending"))


def gates(rows: DataFrame) -> DataFrame:
    """Decisions from not_an_entity, confidence, type, form, candidates (array of ids), chosen, chosen_confidence."""
    n = F.coalesce(F.size("candidates"), F.lit(0))
    conf = F.coalesce("confidence", F.lit(0.0))
    hard = (n > 1) | (conf < AUTOLINK) | F.col("type").eqNullSafe("PER")
    picked = F.col("chosen").isNotNull() & F.array_contains("candidates", F.col("chosen")) & (F.coalesce("chosen_confidence", F.lit(0.0)) >= REVIEW)
    action = (
        F.when(F.coalesce("not_an_entity", F.lit(False)), "drop")
        .when(~hard & (n == 1), "link")
        .when(~hard & (n == 0), "internal")
        .when((n >= 1) & picked, "link")
        .otherwise("needs_review")
    )
    entity = F.when(
        F.col("action") == "link", F.when(hard, F.col("chosen")).otherwise(F.get("candidates", F.lit(0))),
    ).when(F.col("action") == "internal", t.mint_id("form"))
    return rows.withColumn("action", action).withColumns(
        {
            "status": F.when(F.col("action") == "needs_review", "needs_review").otherwise("resolved"),
            "entity_id": entity,
            "writes_alias": F.col("action").isin("link", "internal"),
            "provenance": F.when(F.col("action") == "link", "wikidata").when(F.col("action") == "internal", "llm"),
        }
    )


def person_fast_path(forms: DataFrame, candidates: DataFrame) -> DataFrame:
    """People without any candidate go to review without a model call."""
    found = candidates.select("surface_norm").distinct().withColumn("found", F.lit(True))
    rows = forms.join(found, "surface_norm", "left")
    return rows.withColumn("path", F.when((F.col("type") == "PER") & F.col("found").isNull(), "needs_review").otherwise("model")).drop("found")


def registry_upsert(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Keyed upsert: names and links keep the old value, the description takes the new, confidence the larger."""
    a, b = registry.alias("a"), new.alias("b")
    keep_old = ["canonical_name", "wikidata_id"]
    key = F.coalesce("a.entity_id", "b.entity_id").alias("entity_id")
    return a.join(b, F.col("a.entity_id") == F.col("b.entity_id"), "full_outer").select(
        key,
        *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in keep_old],
        F.when(F.col("a.entity_id").isNull(), F.col("b.type")).otherwise(F.col("a.type")).alias("type"),
        F.when(F.col("a.entity_id").isNull(), F.col("b.description")).otherwise(F.coalesce("b.description", "a.description")).alias("description"),
        F.when(F.col("b.entity_id").isNull(), F.col("a.confidence")).when(F.col("a.entity_id").isNull(), F.col("b.confidence"))
        .otherwise(F.greatest(F.coalesce("a.confidence", F.lit(0.0)), F.coalesce("b.confidence", F.lit(0.0)))).alias("confidence"),
    )


def alias_add(existing: DataFrame, new: DataFrame) -> DataFrame:
    """One owner for each (alias_norm, type): an id of the public base beats a minted one, then what was there, then the smaller id.

    Returns the owner, whether it changed hands, and how many others contend for the alias. Owners are
    minima and counts of distinct rows, which combine before the shuffle, so an alias of any number of
    ids is one row of a task.
    """
    rows = existing.withColumn("old", F.lit(True)).unionByName(new.withColumn("old", F.lit(False)))
    each = rows.groupBy("alias_norm", "type", "entity_id").agg(F.max("old").alias("old"))
    rank = F.struct((~F.coalesce(t.is_qid("entity_id"), F.lit(False))).alias("minted"), (~F.col("old")).alias("new"), "entity_id")
    owners = each.groupBy("alias_norm", "type").agg(
        F.min(rank)["entity_id"].alias("entity_id"), F.max(F.when(F.col("old"), F.col("entity_id"))).alias("was"), F.count("entity_id").alias("n"),
    )
    return owners.select("alias_norm", "type", "entity_id", F.coalesce(F.col("was") != F.col("entity_id"), F.lit(False)).alias("promoted"), (F.col("n") - 1).alias("contenders"))


def promotions(existing: DataFrame, owners: DataFrame) -> DataFrame:
    """Merges that alias_add() brings about: where an id of the public base took an alias over from a minted id, the minted entity goes into it."""
    taken = owners.filter("promoted").select("alias_norm", "type", F.col("entity_id").alias("target"))
    rows = existing.join(taken, ["alias_norm", "type"]).filter((F.col("entity_id") != F.col("target")) & ~t.is_qid("entity_id") & t.is_qid("target"))
    return rows.select(F.col("entity_id").alias("source"), "target").distinct()


def duplicate_classes(registry: DataFrame, *, limit: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Near duplicates of a registry (entity_id, canonical_name, type) as pairs of classes, and who belongs to them.

    Returns pairs (type, class_a <= class_b, similarity, by_acronym) and members (class, block,
    ids): a class is all that names are compared by (type, tokens, years, name without parentheses,
    letters inside them), so a pair holds for every member of the one and of the other, and a class
    that pairs with itself for its own members. Copies cost a row of members, not pairs.

    Names of different years never pair. Classes meet on a shared token of the prefix that a pair of
    the type's threshold must share (tokens in rising order of frequency), so frequent tokens join
    nothing; acronym variants meet on the name without parentheses. Members come in blocks of about
    BLOCK ids. An id is the key of a name: repeated rows count once, an id of several names is in the class of each.
    """
    least = F.lit(limit) if limit is not None else threshold(F.col("type"))
    names = registry.select(
        "entity_id", "type", F.array_sort(t.name_tokens("canonical_name")).alias("tokens"), t.strip_parens("canonical_name").alias("base"),
        t.paren_contents("canonical_name").alias("inside"), t.year_tokens("canonical_name").alias("years"),
    )
    key = ["type", "tokens", "base", "inside", "years"]
    names = materialise(names.withColumn("class", F.sha2(F.to_json(F.struct(*key), {"ignoreNullFields": "false"}), 256)), "entity-names")
    sizes = names.groupBy("class").agg(*[F.first(c).alias(c) for c in key], F.count(F.lit(1)).alias("members"))
    classes = materialise(sizes.withColumn("least", least), "entity-classes")
    blocks = names.select("class", "entity_id").join(classes.select("class", F.ceil(F.col("members") / BLOCK).alias("n")), "class")
    blocks = blocks.groupBy("class", F.pmod(F.xxhash64("entity_id"), F.col("n")).alias("block")).agg(F.sort_array(F.collect_set("entity_id")).alias("ids"))
    each = classes.select("class", "type", "least", "members", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    often = each.groupBy("type", "token").agg(F.sum("members").alias("df"))
    order = Window.partitionBy("class").orderBy("df", "token")
    prefix = each.join(often, ["type", "token"]).withColumn("p", F.row_number().over(order)).filter(F.col("p") <= F.col("n") - F.ceil(F.col("least") * F.col("n")) + 1)
    prefix = materialise(prefix.select("type", "token", "class", "n", "least"), "entity-prefixes")
    side = lambda s: [F.col("type"), F.col("token"), F.col("class").alias(f"class_{s}"), F.col("n").alias(f"n_{s}")]
    pairs = prefix.select(*side("a"), "least").join(prefix.select(*side("b")), ["type", "token"])
    pairs = pairs.filter((F.col("class_a") <= F.col("class_b")) & (F.least("n_a", "n_b") >= F.col("least") * F.greatest("n_a", "n_b"))).select("class_a", "class_b").distinct()
    own = lambda s, *more: classes.select(
        F.col("class").alias(f"class_{s}"), F.col("tokens").alias(f"tokens_{s}"), F.col("years").alias(f"years_{s}"), F.col("members").alias(f"members_{s}"), *more,
    )
    alike = t.jaccard(F.col("tokens_a"), F.col("tokens_b"))
    other = "(class_a < class_b or members_a > 1)"  # an only member has none to pair with
    near = pairs.join(own("a", F.col("type"), F.col("least")), "class_a").join(own("b"), "class_b").filter(f"years_a = years_b and {other}").withColumn("similarity", alike)
    near = near.filter(F.col("similarity") >= F.col("least")).select("type", "class_a", "class_b", "similarity", F.lit(False).alias("by_acronym"))
    full = lambda s: own(s, F.col("type"), F.col("base"), F.col("inside").alias(f"inside_{s}")).filter("base <> ''")
    groups, letters = F.concat("inside_a", "inside_b"), F.regexp_replace("base", "[^a-z]", "")
    short = full("a").join(full("b"), ["type", "base"]).filter(f"class_a <= class_b and {other} and years_a = years_b and size(inside_a) + size(inside_b) > 0")
    short = short.filter(F.forall(groups, lambda p: t.is_subsequence(p, letters))).select(
        "type", "class_a", "class_b", alike.alias("similarity"), F.lit(True).alias("by_acronym"),
    )
    found = near.unionByName(short).groupBy("type", "class_a", "class_b").agg(F.max("similarity").alias("similarity"), F.max("by_acronym").alias("by_acronym"))
    return found, blocks


def class_members(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Every pair (id_a < id_b) of members of the classes that pair, with the other columns of pairs.

    Blocks of members meet, are dealt anew and unfold in the task that writes them, so no pair of
    entities is shuffled, sorted or stored but as a result.
    """
    side = lambda s: members.select(F.col("class").alias(f"class_{s}"), F.col("block").alias(f"block_{s}"), F.col("ids").alias(f"ids_{s}"))
    met = pairs.join(side("a"), "class_a").join(side("b"), "class_b").filter("class_a < class_b or block_a <= block_b")
    more = [c for c in pairs.columns if c not in ("type", "class_a", "class_b")]
    apart = F.expr("class_a < class_b or block_a < block_b").alias("apart")
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number that is stated is not made less for small input
    spread = met.select("type", *more, apart, "ids_a", "ids_b", F.xxhash64("class_a", "block_a", "class_b", "block_b").alias("at")).repartition(tasks, "at")
    rows = spread.withColumn("x", F.explode("ids_a")).drop("ids_a", "at").withColumn("y", F.explode("ids_b")).filter("x < y or apart and x <> y")
    return rows.select("type", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), *more)


def duplicate_candidates(registry: DataFrame, *, limit: float | None = None) -> DataFrame:
    """Pairs (id_a < id_b) of one type that are near duplicates, with their Jaccard similarity and whether one abbreviates the other.

    registry: entity_id, canonical_name, type. Names are compared as classes (see duplicate_classes)
    and the pairs of classes unfold last: copies of a name are all paired, whatever their number.
    """
    return class_members(*duplicate_classes(registry, limit=limit))


def alias_counts(aliases: DataFrame) -> DataFrame:
    """entity_id, n_aliases: distinct (alias_norm, type) of each entity."""
    return aliases.select("entity_id", "alias_norm", "type").distinct().groupBy("entity_id").agg(F.count(F.lit(1)).alias("n_aliases"))


def merge_targets(pairs: DataFrame, alias_counts: DataFrame) -> DataFrame:
    """Which of a pair stays: an id of the public base, then more aliases, then the smaller id."""
    count = lambda s: alias_counts.select(F.col("entity_id").alias(f"id_{s}"), F.col("n_aliases").alias(f"n_{s}"))
    rows = pairs.join(count("a"), "id_a", "left").join(count("b"), "id_b", "left").fillna(0, ["n_a", "n_b"])
    rank = lambda s: F.struct((~t.is_qid(f"id_{s}")).cast("int").alias("q"), (-F.col(f"n_{s}")).alias("n"), F.col(f"id_{s}").alias("id"))
    first = rank("a") < rank("b")
    return rows.withColumns({"target": F.when(first, F.col("id_a")).otherwise(F.col("id_b")), "source": F.when(first, F.col("id_b")).otherwise(F.col("id_a"))})


def merge_map(pairs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """(source, target) with chains followed: each source goes to the best id of its component.

    An id of the public base is best, then (with counts: entity_id, n_aliases) the one of more
    aliases, then the smaller id. Components come from star steps over shuffled edges, a few rounds
    whatever the length of a chain.
    """
    ends = pairs.select("source", "target")
    for c in ("source", "target"):
        n = F.lit(0) if counts is None else F.coalesce("n_aliases", F.lit(0))
        ends = ends if counts is None else ends.join(counts.select(F.col("entity_id").alias(c), "n_aliases"), c, "left")
        rank = F.concat(F.when(t.is_qid(c), F.lit("0")).otherwise(F.lit("1")), F.lpad((F.lit(10**15) - n).cast("string"), 16, "0"), F.col(c))
        ends = ends.withColumn(c, rank).drop("n_aliases")
    roots = connected_components(ends.select(F.col("source").alias("a"), F.col("target").alias("b")))
    plain = lambda c: F.substr(F.col(c), F.lit(18))
    return roots.select(plain("v").alias("source"), plain("root").alias("target"))


def rewrite_mentions(features: DataFrame, mapping: DataFrame) -> DataFrame:
    """Redirect canonical_id inside entities (array of structs) by (source, target); changed tells which rows to write.

    Only the distinct ids of each document travel; the array is rebuilt in place.
    """
    ids = features.select("unique_id", F.explode(F.array_distinct("entities.canonical_id")).alias("source")).filter("source is not null")
    moves = ids.join(mapping, "source").groupBy("unique_id").agg(F.map_from_entries(F.collect_list(F.struct("source", "target"))).alias("moves"))
    rows = features.join(moves, "unique_id", "left")
    moved = F.transform(
        "entities",
        lambda e: e.withField("canonical_id", F.coalesce(F.element_at(F.col("moves"), F.coalesce(e["canonical_id"], F.lit(""))), e["canonical_id"])),
    )
    return rows.withColumns({
        "entities": F.when(F.col("moves").isNull(), F.col("entities")).otherwise(moved), "changed": F.col("moves").isNotNull(),
    }).drop("moves")


def backfill(features: DataFrame, aliases: DataFrame) -> DataFrame:
    """Attach canonical_id to mentions whose normal form and type an alias knows; others keep what they have.

    unique_id, entities, changed, n_linked of every document; null entities stay null, empty ones empty.
    """
    flat = features.select("unique_id", F.col("entities").isNull().alias("none"), F.posexplode_outer("entities").alias("pos", "e"))
    form = F.coalesce(F.nullif(F.col("e.forma_canonica"), F.lit("")), F.col("e.text"))
    flat = flat.withColumns({"alias_norm": t.normalize(form), "type": F.col("e.type")})
    joined = flat.join(aliases.select("alias_norm", "type", "entity_id"), ["alias_norm", "type"], "left")
    new = F.coalesce("entity_id", "e.canonical_id")
    joined = joined.withColumns({
        "differs": F.col("pos").isNotNull() & ~new.eqNullSafe(F.col("e.canonical_id")),
        "linked": F.col("pos").isNotNull() & F.col("entity_id").isNotNull(), "e": F.col("e").withField("canonical_id", new),
    })
    kept = F.when(F.col("pos").isNotNull(), F.struct("pos", "e"))
    done = joined.groupBy("unique_id").agg(
        F.max("none").alias("none"), F.transform(F.array_sort(F.collect_list(kept)), lambda x: x["e"]).alias("entities"),
        F.max("differs").alias("changed"), F.count_if("linked").alias("n_linked"),
    )
    return done.select("unique_id", F.when(~F.col("none"), F.col("entities")).alias("entities"), "changed", "n_linked")


def with_entities(features: DataFrame) -> DataFrame:
    """Rows whose features object (JSON text) has the key entities, be its value null or not."""
    return features.filter(F.array_contains(F.json_object_keys("features"), "entities"))


def mentions_of(features: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose entities hold a canonical_id of ids (entity_id): only distinct ids of each row are shuffled."""
    used = features.select(
        "unique_id", F.explode(F.array_distinct("entities.canonical_id")).alias("entity_id"),
    ).join(ids.select("entity_id"), "entity_id", "left_semi")
    return features.join(used.select("unique_id"), "unique_id", "left_semi")


def rename_aliases(aliases: DataFrame, mapping: DataFrame) -> DataFrame:
    """Aliases that can move to their entity's target (source, target): those whose (alias_norm, type) the target does not hold yet."""
    moving = aliases.join(mapping, F.col("entity_id") == F.col("source")).select("alias_norm", "type", F.col("target").alias("entity_id"))
    return moving.distinct().join(aliases.select("alias_norm", "type", "entity_id"), ["alias_norm", "type", "entity_id"], "left_anti")


def merge_features(old: Column, new: Column) -> Column:
    """Shallow merge of two JSON objects (text): keys of the new one win, at the top level; null is an empty object."""
    parse = lambda c: F.from_json(F.coalesce(c, F.lit("{}")), "map<string,variant>")
    a, b = parse(old), parse(new)
    kept = F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k))
    return F.to_json(F.map_concat(kept, b))


def keep_earlier_entities(old: Column, new: Column) -> Column:
    """An empty extraction never erases earlier entities."""
    return F.when(F.coalesce(F.size(new), F.lit(0)) > 0, new).otherwise(old)


def shortlist(probes: DataFrame, registry: DataFrame, *, k: int = 10, least: float = 0.3) -> DataFrame:
    """For each probe (name, type) the k registry names of the type with the highest trigram similarity of `least` or more; ties to the smaller id.

    Pairs meet on a trigram of the prefix that names of that similarity must share (trigrams in
    rising order of frequency), so common trigrams join nothing.
    """
    p = probes.select("name", "type").distinct().withColumns({"key": F.xxhash64("name", "type"), "grams": t.trigrams("name")})
    r = registry.select("entity_id", "canonical_name", "type", t.trigrams("canonical_name").alias("grams"))
    p, r = materialise(p, "probe-grams"), materialise(r, "registry-grams")
    each = lambda d, key: d.select(key, "type", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    often = each(r, "entity_id").groupBy("type", "g").agg(F.count(F.lit(1)).alias("df"))

    def prefix(d: DataFrame, key: str) -> DataFrame:
        rare = Window.partitionBy(key, "type").orderBy(F.coalesce("df", F.lit(0)), "g")
        rows = each(d, key).join(often, ["type", "g"], "left").withColumn("p", F.row_number().over(rare))
        return rows.filter(F.col("p") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).select(key, "type", "g")

    pairs = prefix(p, "key").join(prefix(r, "entity_id"), ["type", "g"]).select("key", "type", "entity_id").distinct()
    full = pairs.join(p.select("key", "name", F.col("grams").alias("a")), "key").join(
        r.select("entity_id", "type", "canonical_name", F.col("grams").alias("b")), ["entity_id", "type"],
    )
    full = full.withColumn("similarity", t.jaccard(F.col("a"), F.col("b"))).filter(F.col("similarity") >= least)
    best = Window.partitionBy("name", "type").orderBy(F.desc("similarity"), "entity_id")
    return full.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k).select(
        "name", "type", "entity_id", "canonical_name", "similarity", "place",
    )


def reuse_by_name(probes: DataFrame, registry: DataFrame, *, k: int = 10) -> DataFrame:
    """For each probe (name, type) the registry entry to reuse: best score over the type's threshold, else an acronym variant.

    Judged are the k entries of the trigram shortlist and the entries of equal name but for
    parentheses; ties go to the smaller id.
    """
    near = shortlist(probes, registry, k=k).select("name", "type", "entity_id", "canonical_name")
    base = lambda d, c: d.withColumn("_base", t.strip_parens(c)).filter("_base <> ''")
    same = base(probes.select("name", "type").distinct(), "name").join(
        base(registry.select("entity_id", "canonical_name", "type"), "canonical_name"), ["type", "_base"],
    )
    pairs = near.unionByName(same.select(near.columns)).distinct()
    pairs = pairs.filter(~t.differs_by_year("name", "canonical_name")).withColumns({
        "score": t.best_score("name", "canonical_name"), "variant": t.acronym_variant("name", "canonical_name"),
    })
    pairs = pairs.filter((F.col("score") >= threshold(F.col("type"))) | F.col("variant"))
    best = Window.partitionBy("name", "type").orderBy(F.desc(F.col("score") >= threshold(F.col("type"))), F.desc("score"), "entity_id")
    return pairs.withColumn("r", F.row_number().over(best)).filter("r = 1").select("name", "type", "entity_id", "score")


def find_by_public_id(probes: DataFrame, registry: DataFrame) -> DataFrame:
    """For each probe (qid) the registry row with that wikidata_id or entity_id: two equi-joins, one row each."""
    by_link = registry.select(F.col("wikidata_id").alias("qid"), "entity_id", F.lit(1).alias("via"))
    by_key = registry.select(F.col("entity_id").alias("qid"), "entity_id", F.lit(0).alias("via"))
    found = probes.select("qid").distinct().join(by_link.unionByName(by_key), "qid")
    best = Window.partitionBy("qid").orderBy("via", "entity_id")
    return found.withColumn("r", F.row_number().over(best)).filter("r = 1").select("qid", "entity_id")


def merge_registry(registry: DataFrame, mapping: DataFrame) -> DataFrame:
    """Apply (source, target) to the registry: targets inherit missing links and all aliases, sources go.

    registry: entity_id, canonical_name, wikidata_id, description and, if there, aliases (array), type
    and confidence (the target's own, else the first found).
    """
    moved = registry.join(mapping, registry["entity_id"] == mapping["source"], "left").withColumn("home", F.coalesce("target", "entity_id"))
    rank = F.struct((F.col("entity_id") != F.col("home")).cast("int").alias("o"), F.col("entity_id").alias("i"))
    # the first value that is not null, own before inherited: a minimum, so it combines before the shuffle
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(rank.alias("r"), F.col(c).alias("x"))))["x"].alias(c)
    aliases = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("aliases", F.array().cast("array<string>")))))).alias("aliases") if "aliases" in registry.columns else None
    return moved.groupBy(F.col("home").alias("entity_id")).agg(*[aliases if c == "aliases" else first(c) for c in registry.columns if c != "entity_id"])


def merge_aliases(aliases: DataFrame, mapping: DataFrame) -> DataFrame:
    """Redirect aliases to the targets; one row for each (alias_norm, type, entity_id)."""
    moved = aliases.join(mapping.withColumnRenamed("source", "entity_id"), "entity_id", "left")
    return moved.select("alias_norm", "type", F.coalesce("target", "entity_id").alias("entity_id")).distinct()


def orphans(features: DataFrame, registry: DataFrame) -> DataFrame:
    """Mentions whose canonical_id the registry does not know."""
    used = features.select("unique_id", F.explode("entities.canonical_id").alias("entity_id")).filter("entity_id is not null")
    return used.join(registry.select("entity_id"), "entity_id", "left_anti")


def queue(state: DataFrame, *, limit: int | None = None, most_attempts: int = 5) -> DataFrame:
    """Pending forms, oldest first; all of them without a limit."""
    rows = state.filter((F.col("status") == "pending") & (F.coalesce("attempts", F.lit(0)) < most_attempts))
    return rows if limit is None else rows.orderBy(F.col("first_seen_at").asc_nulls_last(), "surface_norm").limit(limit)


def record_outcomes(state: DataFrame, outcomes: DataFrame) -> DataFrame:
    """New state after a run: (surface_norm, type, status, entity_id, error); an error leaves the form pending, an attempt later."""
    new = outcomes.select(
        "surface_norm", "type", F.col("status").alias("s"), F.col("entity_id").alias("e"), F.substring("error", 1, 500).alias("x"),
        F.lit(True).alias("ran"),
    )
    rows = state.join(new, ["surface_norm", "type"], "left")
    failed, ran = F.col("x").isNotNull(), F.col("ran").isNotNull()
    return rows.select(
        "surface_norm", "type",
        F.when(ran & ~failed, F.col("s")).otherwise(F.col("status")).alias("status"),
        F.when(ran & ~failed, F.col("e")).otherwise(F.col("entity_id")).alias("entity_id"),
        (F.coalesce("attempts", F.lit(0)) + (ran & failed).cast("int")).alias("attempts"),
        F.when(ran, F.col("x")).otherwise(F.col("last_error")).alias("last_error"),
        "first_seen_at",
    )


def persist_decisions(decided: DataFrame, registry: DataFrame) -> DataFrame:
    """Final id of each decision: reuse by public id, then by name under the type's threshold, then what the gates minted."""
    known = find_by_public_id(decided.select(F.col("entity_id").alias("qid")), registry).select(
        F.col("qid").alias("entity_id"), F.col("entity_id").alias("by_id"),
    )
    named = reuse_by_name(
        decided.filter("action = 'internal'").select(F.col("form").alias("name"), "type"), registry,
    ).select(F.col("name").alias("form"), "type", F.col("entity_id").alias("by_name"))
    rows = decided.join(known, "entity_id", "left").join(named, ["form", "type"], "left")
    return rows.withColumn("final_id", F.coalesce("by_id", F.when(F.col("action") == "internal", F.col("by_name")), "entity_id")).drop("by_id", "by_name")


def without_raw(articles: DataFrame, raw_log: DataFrame, *, task: str, version: str) -> DataFrame:
    """Articles that have no logged reply for this task and prompt version."""
    done = raw_log.filter((F.col("task") == task) & (F.col("prompt_version") == version)).select("unique_id")
    return articles.join(done, "unique_id", "left_anti")
