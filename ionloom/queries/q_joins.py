"""Join and set-operation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.operators import catalog, decoys, digest, evaluate, joins, resolve
from ionloom.functions import spectra
from ionloom.operators.curation import with_intensity
from ionloom.queries import views
from ionloom.queries.base import Book
from ionloom.queries.q_projections import sql_shuffled
from ionloom.session import materialise
from ionloom.sources import tables

BOOK = Book()
add = BOOK.add

RESOLVED_SQL = """top AS (SELECT *, max(andromeda_score) OVER (PARTITION BY raw_file, scan_number, stripped) AS best FROM candidates),
verdicts AS (SELECT raw_file, scan_number, stripped, count(DISTINCT modified_sequence) > 1 AS unlocalizable, min(modified_sequence) AS modified_sequence,
  max(best) AS andromeda_score FROM top WHERE andromeda_score = best GROUP BY 1, 2, 3),
scans AS (SELECT raw_file, scan_number, count(*) FILTER (NOT unlocalizable) AS peptides, bool_or(unlocalizable) AS any_unlocalizable,
  min(stripped) FILTER (NOT unlocalizable) AS stripped, min(modified_sequence) FILTER (NOT unlocalizable) AS modified_sequence,
  min(andromeda_score) FILTER (NOT unlocalizable) AS andromeda_score FROM verdicts GROUP BY 1, 2),
resolved AS (SELECT * FROM scans WHERE peptides = 1)"""


def scans(spark, sf):
    """Candidates resolved to one row per scan with its status."""
    c = views.candidates(spark, sf)
    verdicts = resolve.localization_verdicts(
        c.select("raw_file", "scan_number", "modified_sequence", "andromeda_score", "precursor_charge"),
        F.substring_index("modified_sequence", "/", 1),
        tie=["precursor_charge"],
    )
    return resolve.resolve_scans(verdicts)


@add(
    "fragment_metadata_join",
    "J1",
    needs=("candidates", "fragments"),
    sql=f"""WITH {RESOLVED_SQL}
SELECT f.raw_file, f.scan_number, f.ion_type, f.no, f.charge, f.intensity, r.modified_sequence FROM fragments f
JOIN resolved r ON r.raw_file = f.raw_file AND r.scan_number = f.scan_number
WHERE f.ion_type IN ('b', 'y') AND f.charge IN (1, 2) AND f.neutral_loss IS NULL""",
)
def fragment_metadata_join(spark, sf):
    meta = resolve.resolved_metadata(scans(spark, sf)).select("raw_file", "scan_number", "modified_sequence")
    kept = resolve.keep_backbone_fragments(views.fragments(spark, sf)).drop("neutral_loss")
    return kept.join(meta, ["raw_file", "scan_number"])


@add(
    "raw_file_semi_join",
    "J2",
    "S2",
    needs=("candidates",),
    sql="""SELECT raw_file, scan_number, modified_sequence, precursor_charge, andromeda_score FROM candidates WHERE raw_file IN (
  SELECT 'run' || (s_suppkey % 10) FROM supplier WHERE s_acctbal > 9500)""",
)
def raw_file_semi_join(spark, sf):
    wanted = (
        views.table(spark, sf, "supplier")
        .where("s_acctbal > 9500")
        .select(F.concat(F.lit("run"), (F.col("s_suppkey") % 10).cast("string")).alias("raw_file"))
    )
    meta = tables.select_metadata(views.candidates(spark, sf))
    return tables.for_raw_files(meta, wanted)


@add(
    "intensity_join",
    "J5",
    needs=("prepared",),
    sql="""SELECT spectrum_id, p.raw_file, p.scan_number, coalesce(precursor_intensity, -1) AS precursor_intensity FROM prepared p LEFT JOIN (
  SELECT 'run' || (event_id % 7) AS raw_file, event_id AS scan_number, min(value) AS precursor_intensity FROM events
  WHERE event_type <> 'error' GROUP BY 1, 2) m ON m.raw_file = p.raw_file AND m.scan_number = p.scan_number""",
)
def intensity_join(spark, sf):
    """One-to-one left join after the metadata is reduced to a row per scan."""
    events = views.table(spark, sf, "events").where("event_type <> 'error'")
    meta = events.select(
        F.concat(F.lit("run"), (F.col("event_id") % 7).cast("string")).alias("raw_file"),
        F.col("event_id").alias("scan_number"),
        F.col("value").alias("precursor_intensity"),
    )
    rows = with_intensity(views.prepared(spark, sf), meta.unionByName(meta))
    return rows.select(
        "spectrum_id", "raw_file", "scan_number", F.coalesce("precursor_intensity", F.lit(-1.0)).alias("precursor_intensity")
    )


@add(
    "cardinality_violations",
    "J6",
    "U5",
    sql="SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
)
def cardinality_violations(spark, sf):
    """What a checked join refuses: keys that would fan out."""
    return joins.duplicates(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@add(
    "checked_join",
    "J6",
    sql="""SELECT l_orderkey, count(*) AS rows, any_value(o_orderpriority) AS o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""",
)
def checked_join(spark, sf):
    lines = views.table(spark, sf, "lineitem").select("l_orderkey")
    orders = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    joined = joins.checked_join(lines, orders, ["l_orderkey"], "inner", validate="m:1")
    return joined.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("rows"), F.max("o_orderpriority").alias("o_orderpriority")
    )


_REVERSED = "substr(peptide, 1, 1) || reverse(substr(peptide, 2, length(peptide) - 2)) || substr(peptide, length(peptide))"


#: A sum over rows of 32 bits of each row's hash: equal row sets have equal digests.
_DIGEST_SQL = "sum(('0x' || substr(md5({}), 1, 8))::BIGINT)::BIGINT"


def _digest(text):
    return F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"))


@add(
    "decoy_collisions",
    "J7",
    needs=("memberships",),
    sql=f"""WITH targets AS (SELECT DISTINCT peptide FROM memberships),
free AS (SELECT peptide, {_REVERSED} AS decoy_peptide FROM targets)
SELECT substr(peptide, 1, 1) AS first_residue, length(peptide)::BIGINT AS length, count(*) AS decoys,
  {_DIGEST_SQL.format("peptide || '>' || decoy_peptide")} AS digest
FROM free LEFT JOIN (SELECT peptide AS taken FROM targets) ON taken = decoy_peptide WHERE taken IS NULL GROUP BY 1, 2""",
)
def decoy_collisions(spark, sf):
    """Free reversals of the whole proteome, every row summed into a digest per first residue and length."""
    targets = views.memberships(spark, sf).select("peptide").distinct()
    free = decoys.without_collisions(decoys.pseudo_reversed(targets), targets)
    return free.groupBy(F.substring("peptide", 1, 1).alias("first_residue"), F.length("peptide").alias("length")).agg(
        F.count(F.lit(1)).alias("decoys"), _digest(F.concat_ws(">", "peptide", "decoy_peptide")).alias("digest")
    )


DECOY_SEARCH_SQL = """WITH RECURSIVE targets AS (SELECT peptide, row_number() OVER (ORDER BY peptide) AS ordinal FROM cleaved),
tries AS (SELECT ordinal, peptide, unnest(range(1, (length(peptide) - 2) // 2 + 1)) AS attempt FROM targets),
candidates AS (SELECT ordinal, attempt, substr(peptide, 1, attempt) || reverse(substr(peptide, attempt + 1, length(peptide) - 2 * attempt))
  || substr(peptide, length(peptide) - attempt + 1) AS identity FROM tries),
free AS (SELECT ordinal, identity, min(attempt) AS attempt FROM candidates WHERE identity NOT IN (SELECT peptide FROM targets) GROUP BY 1, 2),
ranked AS (SELECT ordinal, identity, attempt, row_number() OVER (PARTITION BY ordinal ORDER BY attempt) AS choice FROM free),
rounds AS (
  SELECT 0 AS round, ordinal, 1 AS choice, true AS moved FROM (SELECT DISTINCT ordinal FROM ranked)
  UNION ALL
  SELECT round + 1, ordinal, choice + lost, bool_or(lost = 1) OVER () FROM (
    SELECT s.round, s.ordinal, s.choice, s.moved,
      CASE WHEN r.identity IS NOT NULL AND min(s.ordinal) OVER (PARTITION BY r.identity) < s.ordinal THEN 1 ELSE 0 END AS lost
    FROM rounds s LEFT JOIN ranked r ON r.ordinal = s.ordinal AND r.choice = s.choice WHERE s.moved)),
settled AS (SELECT ordinal, choice FROM rounds WHERE round = (SELECT max(round) FROM rounds))
SELECT t.peptide, coalesce(r.identity, '') AS decoy, coalesce(r.attempt - 1, -1)::BIGINT AS attempt, r.identity IS NOT NULL AS paired
FROM targets t LEFT JOIN settled s ON s.ordinal = t.ordinal LEFT JOIN ranked r ON r.ordinal = s.ordinal AND r.choice = s.choice"""


@add(
    "decoy_search",
    "J8",
    needs=("cleaved",),
    sql=DECOY_SEARCH_SQL,
)
def decoy_search(spark, sf):
    """First free interior reversal of every cleaved peptide, served in peptide order."""
    from ionloom.operators.ordering import with_position

    rows = with_position(views.cleaved(spark, sf), [F.col("peptide").asc()], "ordinal").select(
        "ordinal", "peptide", decoys.no_sites().alias("sites"), F.lit(2).alias("charge"),
        F.lit(False).alias("decoy"), F.col("ordinal").alias("decoy_group"),
    )
    found = decoys.search_decoys(rows, "reverse")
    return found.select(
        "peptide", F.coalesce("identity", F.lit("")).alias("decoy"), F.coalesce("attempt", F.lit(-1)).alias("attempt"), "paired"
    )


@add(
    "shuffled_decoy_search",
    "J8",
    needs=("cleaved",),
    sql=f"""WITH RECURSIVE targets AS (SELECT peptide, row_number() OVER (ORDER BY peptide) AS ordinal FROM cleaved),
rounds AS (
  SELECT 0 AS round, ordinal, peptide, 0 AS attempt, {sql_shuffled(11, '0')} AS identity, true AS moved FROM targets
  UNION ALL
  SELECT round + 1, ordinal, peptide, attempt + lost, CASE WHEN lost = 0 THEN identity WHEN attempt + 1 < 32 THEN {sql_shuffled(11, '(attempt + 1)')} END,
    bool_or(lost = 1) OVER () FROM (
    SELECT *, CASE WHEN identity IS NOT NULL AND (identity IN (SELECT peptide FROM targets)
      OR min(ordinal) OVER (PARTITION BY identity) < ordinal) THEN 1 ELSE 0 END AS lost FROM rounds WHERE moved))
SELECT peptide, identity, CASE WHEN identity IS NOT NULL THEN attempt END::BIGINT AS attempt, identity IS NOT NULL AS paired
FROM rounds WHERE round = (SELECT max(round) FROM rounds)""",
)
def shuffled_decoy_search(spark, sf):
    """The same search with seeded shuffles; checked against a serial search in the tests."""
    from ionloom.operators.ordering import with_position

    rows = with_position(views.cleaved(spark, sf), [F.col("peptide").asc()], "ordinal").select(
        "ordinal", "peptide", decoys.no_sites().alias("sites"), F.lit(2).alias("charge"),
        F.lit(False).alias("decoy"), F.col("ordinal").alias("decoy_group"),
    )
    return decoys.search_decoys(rows, "shuffle", seed=11).select("peptide", "identity", "attempt", "paired")


_ALIASES = [
    (0, 35, 15.994914622, None),
    (1, 4, 57.021463723, 57.02),
    (2, 21, 79.9663312, None),
    (3, 1, 42.0105647, None),
]


@add(
    "mass_alias_join",
    "J9",
    sql="""WITH shifts AS (SELECT DISTINCT round(CASE l_linenumber % 5 WHEN 0 THEN 15.9949::DOUBLE WHEN 1 THEN 57.02::DOUBLE WHEN 2 THEN 57.0215::DOUBLE
  WHEN 3 THEN 79.96633::DOUBLE ELSE 42.0::DOUBLE END + (l_partkey % 7) * 0.00005::DOUBLE, 5) AS shift FROM lineitem),
aliases AS (SELECT * FROM (VALUES (0, 35, 15.994914622::DOUBLE), (1, 4, 57.02::DOUBLE), (2, 21, 79.9663312::DOUBLE), (3, 1, 42.0105647::DOUBLE)) a(o, accession, target))
SELECT shift, coalesce(arg_min(accession, o), -1)::BIGINT AS accession FROM shifts LEFT JOIN aliases ON abs(shift - target) <= 1e-4::DOUBLE GROUP BY 1""",
)
def mass_alias_join(spark, sf):
    """Shifts to declared aliases within tolerance; -1 marks the ones nothing explains."""
    line = F.col("l_linenumber") % 5
    base = (
        F.when(line == 0, 15.9949).when(line == 1, 57.02).when(line == 2, 57.0215).when(line == 3, 79.96633).otherwise(42.0)
    )
    shifts = views.table(spark, sf, "lineitem").select(
        F.round(base + (F.col("l_partkey") % 7) * 0.00005, 5).alias("shift")
    )
    aliases = spark.createDataFrame(
        _ALIASES, "alias_order int, accession int, table_mass double, observed_mass double"
    )
    return joins.resolve_shifts(shifts, aliases).select("shift", F.coalesce("accession", F.lit(-1)).alias("accession"))


def _settings(spark, sf):
    """Two settings documents per supplier group, as key and value rows."""
    s = views.table(spark, sf, "supplier")
    key = F.concat(
        F.when(F.col("s_suppkey") % 9 == 0, "output.k").when(F.col("s_suppkey") % 9 == 1, "inputs.k").otherwise("digest.k"),
        F.col("s_suppkey").cast("string"),
    )
    library = s.where("s_suppkey % 4 <> 1").select(key.alias("key"), F.col("s_nationkey").cast("string").alias("value"))
    expected = s.where("s_suppkey % 4 <> 2").select(
        key.alias("key"),
        F.when(F.col("s_suppkey") % 5 == 0, "changed").otherwise(F.col("s_nationkey").cast("string")).alias("value"),
    )
    legacy = s.agg(F.max("s_name").alias("value"))
    library = library.unionByName(legacy.select(F.lit("inputs.fasta_blake2b_256").alias("key"), "value"))
    expected = expected.unionByName(
        legacy.select(F.lit("inputs.sequence.blake2b_256").alias("key"), "value")
    ).unionByName(legacy.select(F.lit("inputs.sequence.kind").alias("key"), F.lit("fasta").alias("value")))
    return library, expected


_SETTINGS_SQL = """doc AS (SELECT CASE s_suppkey % 9 WHEN 0 THEN 'output.k' WHEN 1 THEN 'inputs.k' ELSE 'digest.k' END || s_suppkey AS key,
  s_suppkey, s_nationkey::VARCHAR AS value FROM supplier WHERE s_suppkey % 9 <> 0),
lib AS (SELECT key, value FROM doc WHERE s_suppkey % 4 <> 1),
want AS (SELECT key, CASE WHEN s_suppkey % 5 = 0 THEN 'changed' ELSE value END AS value FROM doc WHERE s_suppkey % 4 <> 2),
diff AS (SELECT key, lib.value AS library, want.value AS expected FROM lib FULL OUTER JOIN want USING (key)
  WHERE lib.value IS DISTINCT FROM want.value)"""


@add(
    "settings_difference",
    "J11",
    "U4",
    sql=f"WITH {_SETTINGS_SQL} SELECT key, coalesce(library, '(none)') AS library, coalesce(expected, '(none)') AS expected FROM diff",
)
def settings_difference(spark, sf):
    """Keys two documents disagree about; build facts, paths and renamed keys do not count."""
    library, expected = _settings(spark, sf)
    diff = joins.settings_difference(catalog.comparable_settings(library), catalog.comparable_settings(expected))
    return diff.select(
        "key", F.coalesce("library", F.lit("(none)")).alias("library"), F.coalesce("expected", F.lit("(none)")).alias("expected")
    )


@add(
    "settings_verdict",
    "J11",
    sql=f"WITH {_SETTINGS_SQL} SELECT CASE WHEN count(*) = 0 THEN 'same' ELSE 'different' END AS verdict, count(*) AS differences FROM diff",
)
def settings_verdict(spark, sf):
    return catalog.check_settings(*_settings(spark, sf))


@add(
    "rule_overlap",
    "J12",
    sql="""WITH fixed AS (SELECT p_brand AS rule, unnest(string_split(upper(regexp_replace(p_type, '[^A-Za-z]', '', 'g')), '')) AS t FROM part),
variable AS (SELECT p_name AS rule, unnest(string_split(upper(regexp_replace(p_name, '[^A-Za-z]', '', 'g')), '')) AS t FROM part)
SELECT rule, string_agg(t, '' ORDER BY t) AS shared FROM (SELECT DISTINCT rule, t FROM variable WHERE t IN (SELECT t FROM fixed)) GROUP BY 1""",
)
def rule_overlap(spark, sf):
    part = views.table(spark, sf, "part")

    def rules(name: str, letters: str):
        text = F.upper(F.regexp_replace(letters, "[^A-Za-z]", ""))
        exploded = part.select(F.col(name).alias("rule"), F.explode(F.split(text, "")).alias("t")).distinct()
        return exploded.groupBy("rule").agg(F.collect_set("t").alias("targets"))  # at most 26 letters

    found = joins.overlapping_rules(rules("p_brand", "p_type"), rules("p_name", "p_name"))
    return found.select("rule", F.array_join("shared", "").alias("shared"))


@add(
    "reference_distribution_merge",
    "J13",
    needs=("pair_angles",),
    sql="""WITH h AS (SELECT 'set' || (context % 7) AS dataset, count(*) AS n FROM pair_angles GROUP BY 1),
labeler AS (SELECT dataset, n FROM h WHERE dataset <> 'set1'), ceiling AS (SELECT dataset, n + 1 AS n FROM h WHERE dataset <> 'set2')
SELECT dataset, coalesce(l.n, -1) AS labeler, coalesce(c.n, -1) AS ceiling FROM labeler l FULL OUTER JOIN ceiling c USING (dataset)""",
)
def reference_distribution_merge(spark, sf):
    counts = views.pairs(spark, sf).groupBy(
        F.concat(F.lit("set"), (F.col("context") % 7).cast("string")).alias("dataset")
    ).agg(F.count(F.lit(1)).alias("n"))
    merged = evaluate.merge_reference_distributions(
        counts.where("dataset <> 'set1'").select("dataset", F.col("n").alias("histogram")),
        counts.where("dataset <> 'set2'").select("dataset", (F.col("n") + 1).alias("histogram")),
    )
    return merged.select(
        "dataset", F.coalesce("labeler", F.lit(-1)).alias("labeler"), F.coalesce("ceiling", F.lit(-1)).alias("ceiling")
    )


@add(
    "target_decoy_pairs",
    "J14",
    needs=("memberships",),
    sql=f"""WITH targets AS (SELECT peptide, row_number() OVER (ORDER BY peptide) - 1 AS form FROM (SELECT DISTINCT peptide FROM memberships)),
decoys AS (SELECT form, {_REVERSED} AS decoy FROM targets),
free AS (SELECT decoys.* FROM decoys LEFT JOIN (SELECT peptide AS taken FROM targets) ON taken = decoy WHERE taken IS NULL),
pairs AS (SELECT form * 2 + 1 + z - 2 AS decoy_group, z::BIGINT AS charge, peptide AS target, decoy FROM targets JOIN free USING (form) CROSS JOIN range(2, 4) r(z))
SELECT charge, substr(target, 1, 1) AS first_residue, count(*) AS pairs, min(decoy_group) AS first_group, max(decoy_group) AS last_group,
  {_DIGEST_SQL.format("decoy_group || '|' || target || '|' || decoy")} AS digest FROM pairs GROUP BY 1, 2""",
)
def target_decoy_pairs(spark, sf):
    """Each charged target with its decoy by competition group; collisions stay unpaired."""
    # Read twice below, as is what is numbered: the digest is not made again.
    forms = materialise(views.memberships(spark, sf).select("peptide").distinct())
    numbered = decoys.number_decoy_groups(forms, [F.col("peptide").asc()], 2, 3)
    reversed_ = decoys.without_collisions(decoys.pseudo_reversed(numbered), forms)
    pairs = decoys.pair_targets(
        numbered.select("decoy_group", "charge", F.col("peptide").alias("target")),
        reversed_.select("decoy_group", "charge", F.col("decoy_peptide").alias("decoy")),
    )
    return pairs.groupBy("charge", F.substring("target", 1, 1).alias("first_residue")).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.min("decoy_group").alias("first_group"),
        F.max("decoy_group").alias("last_group"),
        _digest(F.concat_ws("|", F.col("decoy_group").cast("string"), "target", "decoy")).alias("digest"),
    )


@add(
    "scored_pairs",
    "J15",
    needs=("precursors", "spectra"),
    sql="""SELECT peptide, charge, round(1 - 2 * acos(greatest(least(sum(value * sqrt(value)) /
  (sqrt(sum(value * value)) * sqrt(sum(value))), 1), -1)) / pi(), 6) AS angle
FROM precursors p JOIN spectra s ON s.spectrum_id = p.spectrum_id GROUP BY 1, 2""",
)
def scored_pairs(spark, sf):
    """Observed spectra joined to predictions of the same precursor (here their square roots)."""
    rows = views.precursors(spark, sf)
    observed = rows.select("peptide", "charge", F.col("ms2").alias("observed"))
    predicted = rows.select("peptide", "charge", F.transform("ms2", lambda x: F.sqrt(x)).alias("predicted"))
    pairs = joins.scored_pairs(predicted, observed, ["peptide", "charge"])
    return pairs.select(
        "peptide", "charge", spectra.spectral_angle(F.col("predicted"), F.col("observed")).alias("angle")
    )


@add(
    "shard_completion",
    "J16",
    "U3",
    sql="""SELECT 'src' || s_nationkey AS source_id, s_suppkey AS shard_index,
  s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS complete FROM supplier""",
)
def shard_completion(spark, sf):
    """Tasks against manifests: some are missing, some stale, some of an old version."""
    return _completion(spark, sf).select("source_id", "shard_index", "complete")


@add(
    "completion_counts",
    "J16",
    sql="""WITH c AS (SELECT s_suppkey % 3 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0 AS done FROM supplier)
SELECT count(*) FILTER (done) AS complete, count(*) FILTER (NOT done) AS missing, count(*) AS total FROM c""",
)
def completion_counts(spark, sf):
    return catalog.completion_counts(_completion(spark, sf))


def _completion(spark, sf):
    s = views.table(spark, sf, "supplier")
    tasks = s.select(
        F.concat(F.lit("src"), F.col("s_nationkey").cast("string")).alias("source_id"), F.col("s_suppkey").alias("shard_index")
    )
    uri = F.concat_ws(
        "/", F.lit("base"), F.lit("shards"), F.concat(F.lit("src"), F.col("s_nationkey").cast("string")),
        F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), F.lit("data.parquet"),
    )
    manifests = s.where("s_suppkey % 3 <> 0").select(
        F.when(F.col("s_suppkey") % 7 == 0, 2).otherwise(1).alias("version"),
        uri.alias("data_uri"),
        F.struct(F.when(F.col("s_suppkey") % 5 == 0, "old").otherwise("now").alias("config_fingerprint")).alias("task"),
    )
    return catalog.completion(tasks, manifests, "now", "base")


@add(
    "target_decoy_union",
    "U1",
    needs=("cleaved",),
    sql=f"SELECT peptide, false AS decoy FROM cleaved UNION ALL SELECT {_REVERSED}, true FROM cleaved",
)
def target_decoy_union(spark, sf):
    targets = views.cleaved(spark, sf)
    reversed_ = decoys.pseudo_reversed(targets).select(F.col("decoy_peptide").alias("peptide"))
    return targets.withColumn("decoy", F.lit(False)).unionByName(reversed_.withColumn("decoy", F.lit(True)))


@add(
    "distinct_dataset_splits",
    "U2",
    needs=("prepared",),
    sql="SELECT DISTINCT dataset, split FROM prepared",
)
def distinct_dataset_splits(spark, sf):
    return views.prepared(spark, sf).select("dataset", "split").distinct()


@add(
    "missing_shards",
    "U3",
    sql="SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
)
def missing_shards(spark, sf):
    present = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.missing_keys(views.table(spark, sf, "orders"), present, ["o_orderkey"])


@add(
    "protein_group_membership",
    "A3",
    needs=("memberships",),
    sql="""SELECT peptide, count(DISTINCT protein_id) AS n_proteins, min(protein_id) AS first_protein FROM memberships GROUP BY 1""",
)
def protein_group_membership(spark, sf):
    return digest.protein_groups(views.memberships(spark, sf))


@add(
    "protein_lists",
    "A3",
    needs=("memberships",),
    sql="""SELECT peptide, count(*) AS n_proteins, string_agg(protein_id, ';' ORDER BY protein_id) AS proteins
  FROM (SELECT DISTINCT peptide, protein_id FROM memberships) GROUP BY 1""",
)
def protein_lists(spark, sf):
    """Sorted protein lists of every group, whatever its size."""
    lists = digest.protein_lists(views.memberships(spark, sf))
    return lists.select("peptide", "n_proteins", F.array_join("proteins", ";").alias("proteins"))


