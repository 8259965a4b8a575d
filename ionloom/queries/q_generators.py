"""Row-generating queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ionloom.constants import ABUNDANCE
from ionloom.functions.sequence import mods_text, parse_rule
from ionloom.operators import digest, modforms, sampling
from ionloom.queries import views
from ionloom.queries.base import Book
from ionloom.queries.views import sql_uniform
from ionloom.session import spread

BOOK = Book()
add = BOOK.add


@add(
    "tryptic_digest",
    "G1",
    needs=("memberships",),
    sql="SELECT protein_id, peptide, count(*) AS occurrences FROM memberships GROUP BY 1, 2",
)
def tryptic_digest(spark, sf):
    return views.memberships(spark, sf).groupBy("protein_id", "peptide").agg(F.count(F.lit(1)).alias("occurrences"))


@add(
    "enzyme_comparison",
    "G1",
    needs=("proteome",),
    sql="""WITH cut AS (
  SELECT protein_id, 'lysc' AS enzyme, replace(residues, 'K', 'K|') AS marked FROM proteome
  UNION ALL SELECT protein_id, 'trypsin/p', replace(replace(residues, 'K', 'K|'), 'R', 'R|') FROM proteome),
split AS (SELECT protein_id, enzyme, unnest(string_split(marked, '|')) AS piece FROM cut)
SELECT enzyme, count(*) AS peptides, count(DISTINCT piece) AS distinct_peptides, sum(length(piece))::BIGINT AS residues,
  min(piece) AS first, max(piece) AS last FROM split WHERE length(piece) BETWEEN 5 AND 40 GROUP BY 1""",
)
def enzyme_comparison(spark, sf):
    parts = []
    for enzyme in ("lysc", "trypsin/p"):
        rules = digest.DigestRules(enzyme, missed_cleavages=0, min_length=5, max_length=40)
        parts.append(digest.digest(views.proteome(spark, sf), rules).withColumn("enzyme", F.lit(enzyme)))
    return parts[0].unionByName(parts[1]).groupBy("enzyme").agg(
        F.count(F.lit(1)).alias("peptides"),
        F.count_distinct("peptide").alias("distinct_peptides"),
        F.sum(F.length("peptide")).alias("residues"),
        F.min("peptide").alias("first"),
        F.max("peptide").alias("last"),
    )


@add(
    "digest_guards",
    "G2",
    needs=("memberships",),
    sql="""SELECT 'reachable' AS check, count(*) > 0 AS passes FROM memberships
UNION ALL SELECT 'window beyond reach', false""",
)
def digest_guards(spark, sf):
    """A digest that yields rows passes; an unreachable length window is refused before any read."""
    rules = digest.DigestRules()
    checked = digest.require_peptides(views.memberships(spark, sf), rules)
    first = checked.agg((F.count(F.lit(1)) > 0).alias("passes")).select(F.lit("reachable").alias("check"), "passes")
    try:
        digest.DigestRules("unspecific", missed_cleavages=2)
        refused = False
    except ValueError:
        refused = True
    second = first.select(F.lit("window beyond reach").alias("check"), F.lit(not refused).alias("passes"))
    return first.unionByName(second)


@add(
    "sequence_windows",
    "G3",
    needs=("proteome",),
    sql="WITH letters AS (SELECT protein_id, unnest(string_split(residues, '')) AS r, generate_subscripts(string_split(residues, ''), 1) AS i FROM proteome),\n"
    + "eights AS (SELECT r" + "".join(f" || lead(r, {k}) OVER w" for k in range(1, 8)) + " AS w8, "
    + ", ".join(f"lead(r, {k}) OVER w AS r{k}" for k in (8, 9, 10))
    + """ FROM letters WINDOW w AS (PARTITION BY protein_id ORDER BY i)),
windows AS (SELECT 8 AS width, w8 AS word FROM eights UNION ALL SELECT 9, w8 || r8 FROM eights UNION ALL SELECT 10, w8 || r8 || r9 FROM eights
  UNION ALL SELECT 11, w8 || r8 || r9 || r10 FROM eights)
SELECT width::BIGINT AS width, substr(word, 1, 2) AS head, count(*) AS windows, min(word) AS first, max(word) AS last FROM windows WHERE word IS NOT NULL GROUP BY ALL""",
)
def sequence_windows(spark, sf):
    """All windows of 8 to 11 residues of every protein, counted by width and first two residues.

    The first and last one are found as numbers, which aggregate by hash; text would be sorted first, all windows of it.
    """
    windows = digest.windows(views.proteome(spark, sf), 8, 11, numbered=True)
    counted = windows.groupBy("width", F.substring("window", 1, 2).alias("head")).agg(
        F.count(F.lit(1)).alias("windows"), F.min("number").alias("first"), F.max("number").alias("last")
    )
    text = digest.window_text
    return counted.select("width", "head", "windows", text(F.col("first")).alias("first"), text(F.col("last")).alias("last"))


_FIXED = [parse_rule("C[UNIMOD:4]")]
_VARIABLE = [parse_rule("M[UNIMOD:35]"), parse_rule("ST[UNIMOD:21]"), parse_rule("[UNIMOD:1]-")]

_CANDIDATES = """letters AS (SELECT peptide, unnest(string_split(peptide, '')) AS r, generate_subscripts(string_split(peptide, ''), 1) - 1 AS pos FROM cleaved),
candidates AS (
  SELECT peptide, 0 AS rule, pos, pos::VARCHAR AS site, 'UNIMOD:35' AS spec FROM letters WHERE r = 'M'
  UNION ALL SELECT peptide, 1, pos, pos::VARCHAR, 'UNIMOD:21' FROM letters WHERE r IN ('S', 'T')
  UNION ALL SELECT peptide, 2, 0, 'n', 'UNIMOD:1' FROM cleaved)"""


@add(
    "modified_forms",
    "G4",
    needs=("cleaved",),
    sql=f"""WITH {_CANDIDATES},
forms AS (SELECT peptide, 0 AS n, '' AS form FROM cleaved
  UNION ALL SELECT peptide, 1, site || ':' || spec FROM candidates
  UNION ALL SELECT a.peptide, 2, a.site || ':' || a.spec || ';' || b.site || ':' || b.spec FROM candidates a
    JOIN candidates b ON a.peptide = b.peptide AND (b.rule, b.pos) > (a.rule, a.pos))
SELECT peptide, count(*) AS forms, count(*) FILTER (n = 2) AS doubles, min(form) AS first, max(form) AS last FROM forms GROUP BY 1""",
)
def modified_forms(spark, sf):
    """All forms with up to two variable sites of every cleaved peptide."""
    forms = modforms.modified_forms(views.cleaved(spark, sf), [], _VARIABLE, 2)
    text = mods_text(F.col("sites"))
    return forms.withColumn("form", text).groupBy("peptide").agg(
        F.count(F.lit(1)).alias("forms"),
        F.count_if(F.col("n_variable") == 2).alias("doubles"),
        F.min("form").alias("first"),
        F.max("form").alias("last"),
    )


@add(
    "same_site_forms",
    "G4",
    needs=("cleaved",),
    sql="""WITH m AS (SELECT peptide, length(peptide) - length(replace(peptide, 'M', '')) AS n FROM cleaved)
SELECT peptide, (1 + 2 * n + (2 * n) * (2 * n - 1) // 2)::BIGINT AS all_pairs,
  (1 + 2 * n + (2 * n) * (2 * n - 1) // 2 - n)::BIGINT AS one_per_site FROM m""",
)
def same_site_forms(spark, sf):
    """Two rules on one residue: every pair, or only pairs on different sites."""
    rules = [parse_rule("M[UNIMOD:35]"), parse_rule("M[UNIMOD:4]")]

    def counted(one_per_site, name):
        forms = modforms.modified_forms(views.cleaved(spark, sf), [], rules, 2, one_per_site)
        return forms.groupBy("peptide").agg(F.count(F.lit(1)).alias(name))

    return counted(False, "all_pairs").join(counted(True, "one_per_site"), "peptide")


@add(
    "charge_expansion",
    "G5",
    "J10",
    needs=("cleaved",),
    sql="""SELECT peptide, charge::BIGINT AS charge, energy::DOUBLE AS energy FROM cleaved CROSS JOIN range(2, 5) t(charge)
  CROSS JOIN (VALUES (25.0), (30.0)) e(energy)""",
)
def charge_expansion(spark, sf):
    """Peptides by charges by settings: grids are small constants, so they explode inside the row."""
    rows = modforms.expand_charges(views.cleaved(spark, sf), 2, 4)
    return rows.withColumn("energy", F.explode(F.array(F.lit(25.0), F.lit(30.0))))


@add(
    "sampled_forms",
    "G6",
    needs=("cleaved",),
    sql=f"""WITH {_CANDIDATES},
drawn AS (SELECT * FROM (SELECT *, {sql_uniform('forms-draw', 'peptide', 'rule', 'pos')} AS u,
  {sql_uniform('forms-keep', 'peptide', 'rule', 'pos')} AS keep FROM candidates)
  WHERE u < CASE rule WHEN 0 THEN 0.5 WHEN 1 THEN 0.3 ELSE 0.1 END),
kept AS (SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY peptide ORDER BY keep, rule, pos) <= 2)
SELECT c.peptide, (2 + floor({sql_uniform('charge', 'c.peptide')} * 3))::BIGINT AS charge, coalesce(k.form, '') AS form FROM cleaved c LEFT JOIN
  (SELECT peptide, string_agg(site || ':' || spec, ';' ORDER BY rule, pos) AS form FROM kept GROUP BY 1) k ON k.peptide = c.peptide""",
)
def sampled_forms(spark, sf):
    rules = list(zip(_VARIABLE, (0.5, 0.3, 0.1)))
    forms = modforms.sampled_forms(views.cleaved(spark, sf), rules, 2)
    return modforms.sampled_charge(forms, 2, 4).select("peptide", "charge", mods_text(F.col("sites")).alias("form"))


def _residue_sql() -> str:
    total, running, out = sum(ABUNDANCE.values()), 0.0, "CASE"
    for residue in sorted(ABUNDANCE):
        running += ABUNDANCE[residue]
        out += f" WHEN u < {running / total!r}::DOUBLE THEN '{residue}'"
    return out + f" ELSE '{max(ABUNDANCE)}' END"


@add(
    "random_peptides",
    "G7",
    sql=f"""WITH drawn AS (SELECT p_partkey, (7 + floor({sql_uniform('random-length', 'p_partkey')} * 24))::BIGINT AS length FROM part),
residues AS (SELECT p_partkey, i, {_residue_sql()} AS r FROM (SELECT p_partkey, i, {sql_uniform('random-residue', 'p_partkey', 'i')} AS u
  FROM (SELECT p_partkey, unnest(range(1, length)) AS i FROM drawn)))
SELECT d.p_partkey, d.length, body || CASE WHEN {sql_uniform('random-end', 'd.p_partkey')} < 0.5 THEN 'K' ELSE 'R' END AS peptide
FROM drawn d JOIN (SELECT p_partkey, string_agg(r, '' ORDER BY i) AS body FROM residues GROUP BY 1) b ON b.p_partkey = d.p_partkey""",
)
def random_peptides(spark, sf):
    seeds = spread(views.table(spark, sf, "part").select("p_partkey"), "p_partkey")
    return sampling.random_peptides(seeds, "p_partkey")


@add(
    "random_windows",
    "G7",
    needs=("proteome",),
    sql=f"""WITH placed AS (SELECT protein_id, residues, row_number() OVER (ORDER BY protein_id) - 1 AS place, count(*) OVER () AS n
  FROM proteome WHERE length(residues) >= 8),
drawn AS (SELECT p_partkey, floor({sql_uniform('window-protein', 'p_partkey')} * (SELECT max(n) FROM placed))::BIGINT AS place FROM part),
sized AS (SELECT d.p_partkey, p.protein_id, p.residues,
  (8 + floor({sql_uniform('window-width', 'd.p_partkey')} * (least(11, length(p.residues)) - 8 + 1)))::BIGINT AS width
  FROM drawn d JOIN placed p ON p.place = d.place)
SELECT p_partkey, protein_id, width, start, substr(residues, start + 1, width) AS "window" FROM (SELECT *,
  floor({sql_uniform('window-start', 'p_partkey')} * (length(residues) - width + 1))::BIGINT AS start FROM sized)""",
)
def random_windows(spark, sf):
    seeds = views.table(spark, sf, "part").select("p_partkey")
    return sampling.random_windows(seeds, "p_partkey", views.proteome(spark, sf))


@add(
    "energy_sweep",
    "G9",
    needs=("cleaved",),
    sql=f"SELECT peptide, round(20.0 + {sql_uniform('energy', 'peptide')} * 15.0, 6) AS energy FROM cleaved",
)
def energy_sweep(spark, sf):
    return modforms.energy_sweep(views.cleaved(spark, sf), 20.0, 35.0, ["peptide"])


@add(
    "round_robin",
    "G10",
    sql="""SELECT event_type, event_id, row_number() OVER (ORDER BY rn, event_type) - 1 AS turn FROM (
  SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events)""",
)
def round_robin(spark, sf):
    mixes = views.table(spark, sf, "events").select("event_type", "event_id")
    return sampling.round_robin(mixes, "event_type", [F.col("event_id").asc()])
