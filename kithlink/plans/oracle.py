"""The same queries as plain SQL over the input tables, for an independent engine.

`CTES` holds named steps in order of dependency; `with_steps` puts the steps a query
mentions, directly or through other steps, in front of it.
"""

from __future__ import annotations

import re

from kithlink.plans import study
from kithlink.sources import fixtures

CTES: dict[str, str] = {}
QUERIES: dict[str, str] = {}


def step(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def query(name: str, sql: str) -> None:
    QUERIES[name] = sql.strip()


def with_steps(sql: str) -> str:
    needed: set[str] = set()
    frontier = [sql]
    while frontier:
        words = set(re.findall(r"\w+", frontier.pop()))
        for name in words & CTES.keys() - needed:
            needed.add(name)
            frontier.append(CTES[name])
    if not needed:
        return sql
    body = ",\n".join(f"{name} AS ({CTES[name]})" for name in CTES if name in needed)
    rest = sql.removeprefix("WITH ")
    return f"WITH RECURSIVE {body}{', ' if rest != sql else ' '}\n{rest}"


def oracle_sql() -> dict[str, str]:
    return {name: with_steps(sql) for name, sql in QUERIES.items()}


def average_linkage_steps(prefix: str, links: str, cut: float) -> None:
    """Step {prefix}_turns from `links` (model, a, b, total; a < b): in each turn clusters that are each other's nearest merge.

    Kind L has the links between clusters, kind N the cluster of each record; the last turn of a model is its result.
    """
    step(f"{prefix}_links", links)
    step(f"{prefix}_turns", f"""
SELECT model, 0 AS turn, 'L' AS kind, a, b, total, 1 AS na, 1 AS nb FROM {prefix}_links
UNION ALL
SELECT DISTINCT model, 0, 'N', r, r, 0.0::DOUBLE, 1, 1 FROM (SELECT model, unnest([a, b]) AS r FROM {prefix}_links WHERE total >= {cut})
UNION ALL
(WITH near AS (
   SELECT model, turn, a, b, na, nb, round(total / (na * nb), 12) AS mean FROM {prefix}_turns
   WHERE kind = 'L' AND round(total / (na * nb), 12) >= {cut}),
 best AS (
   SELECT model, x, min({{'m': -mean, 'a': a, 'b': b, 'n': na + nb}}) AS r
   FROM (SELECT *, a AS x FROM near UNION ALL SELECT *, b AS x FROM near) GROUP BY model, x),
 merges AS (SELECT model, (r).b AS old, (r).a AS new, (r).n AS n FROM best GROUP BY model, r HAVING count(*) = 2),
 moved AS (
   SELECT t.model, turn, kind, CASE WHEN kind = 'L' THEN coalesce(ma.new, t.a) ELSE t.a END AS a, coalesce(mb.new, t.b) AS b, total,
          coalesce(ma.n, sa.n, na) AS na, coalesce(mb.n, sb.n, nb) AS nb
   FROM {prefix}_turns t
   LEFT JOIN merges ma ON ma.model = t.model AND ma.old = t.a LEFT JOIN merges mb ON mb.model = t.model AND mb.old = t.b
   LEFT JOIN merges sa ON sa.model = t.model AND sa.new = t.a LEFT JOIN merges sb ON sb.model = t.model AND sb.new = t.b
   WHERE t.model IN (SELECT model FROM merges))
 SELECT model, turn + 1, kind, CASE WHEN kind = 'L' THEN least(a, b) ELSE a END, CASE WHEN kind = 'L' THEN greatest(a, b) ELSE b END, sum(total),
        max(CASE WHEN a <= b OR kind = 'N' THEN na ELSE nb END), max(CASE WHEN a <= b OR kind = 'N' THEN nb ELSE na END)
 FROM moved WHERE kind = 'N' OR a <> b GROUP BY 1, 2, 3, 4, 5)""")
    step(f"{prefix}_last", f"""
SELECT model, a AS rowid, b AS cluster_id FROM {prefix}_turns t
WHERE kind = 'N' AND turn = (SELECT max(turn) FROM {prefix}_turns x WHERE x.model = t.model)""")


# -- records --------------------------------------------------------------------------

step("raw_cases", fixtures.RAW_CASES_SQL.format(orders="orders"))
step("raw_charges", fixtures.RAW_CHARGES_SQL.format(cases="raw_cases", lineitem="lineitem"))

_PARSED = """
SELECT casnbr, CAST(try_strptime(casfildat, '%m/%d/%Y') AS DATE) AS casfildat, sid, name, dob, sex, race,
       CAST(try_strptime(dob, '%m/%d/%Y') AS DATE) AS date_of_birth {more}
FROM {table}"""
step("dated", _PARSED.format(table="raw_cases", more=""))
step("dated_charges", _PARSED.format(table="raw_charges", more=", ingest_order"))
_USABLE = """
SELECT casnbr, casfildat, CAST(trunc(TRY_CAST(sid AS DOUBLE)) AS BIGINT) AS sid, name, dob, sex,
       CASE WHEN race = 'NULL' THEN '' ELSE race END AS race, date_of_birth {more}
FROM {table}
WHERE name <> '' AND contains(name, ' ') AND sid <> 'M' AND TRY_CAST(sid AS DOUBLE) > 100"""
step("usable", _USABLE.format(table="dated", more=""))
step("usable_charges", _USABLE.format(table="dated_charges", more=", ingest_order"))
step("numbered", "SELECT *, row_number() OVER (ORDER BY sid, casnbr) AS rowid FROM usable")
step("named", """
SELECT casnbr, casfildat, sid, name, sex, race, date_of_birth, rowid,
       split_part(name, ' ', 1) AS last_name, split_part(name, ' ', 2) AS first_name,
       regexp_extract(name, '^[^ ]* [^ ]* (.*)$', 1) AS middle_name
FROM numbered""")
step("cases", """
SELECT *, CAST(floor((casfildat - date_of_birth) / 365.25) AS INTEGER) AS age FROM named
WHERE first_name NOT IN ('', 'NA', 'NULL', 'NAN') AND last_name NOT IN ('', 'NA', 'NULL', 'NAN')""")
step("suffixed", """
SELECT *, nullif(regexp_extract(nullif(middle_name, ''), '([A-Za-z ]+)', 1), '') AS letters FROM cases""")
step("persons", """
SELECT rowid, first_name, last_name, date_of_birth,
       CAST(trunc((DATE '2020-01-01' - date_of_birth) / 365.2425) AS INTEGER) AS age_in_2020,
       trim(regexp_replace(letters, ' (JR|SR|II|III|IV|V)$', '')) AS middle_name,
       substr(trim(regexp_replace(letters, ' (JR|SR|II|III|IV|V)$', '')), 1, 1) AS middle_initial,
       nullif(regexp_extract(letters, ' (JR|SR|II|III|IV|V)$', 1), '') AS lineage,
       nullif(race, '') AS race, CASE WHEN sex IN ('F', 'M') THEN sex END AS sex,
       'SID' || CAST(sid AS VARCHAR) AS sid, 'SID' || CAST(sid AS VARCHAR) AS uid_sid
FROM suffixed""")
step("keyed", """
SELECT *, first_name || ' ' || last_name || ' ' || CAST(date_of_birth AS VARCHAR) AS name_dob FROM persons""")
step("person_stats", """
SELECT sid, count(DISTINCT rowid) AS n_records, count(DISTINCT name_dob) AS n_uq_namedob FROM keyed GROUP BY sid""")
step("spelling_stats", """
SELECT sid, name_dob, count(DISTINCT rowid) AS n_records_per_sid_name_dob FROM keyed
WHERE name_dob IS NOT NULL GROUP BY sid, name_dob""")
_STATS = """
SELECT k.*, k.sid || ' ' || k.name_dob AS sid_name_dob, p.n_records, p.n_uq_namedob, s.n_records_per_sid_name_dob,
       CAST(p.n_uq_namedob > 1 AS INTEGER) AS any_non_exact_match,
       CAST(p.n_uq_namedob > 1 AND p.n_uq_namedob = p.n_records AS INTEGER) AS all_non_exact_match
FROM {keyed} k JOIN {persons} p USING (sid) LEFT JOIN {spellings} s ON s.sid = k.sid AND s.name_dob = k.name_dob"""
step("profiled", _STATS.format(keyed="keyed", persons="person_stats", spellings="spelling_stats"))
step("classed", """
SELECT *, CASE WHEN n_records = 1 THEN 'singleton' WHEN n_uq_namedob = 1 THEN 'exact'
               WHEN n_uq_namedob = n_records THEN 'different' ELSE 'mixed' END AS entity_class
FROM profiled""")

# -- cleaning -------------------------------------------------------------------------

query("raw_scan", """
SELECT casnbr, casfildat, sid, name, dob, sex, race, count(*) AS n FROM raw_charges GROUP BY ALL""")
query("string_scan", """
SELECT CAST(casnbr AS BIGINT) AS casnbr, CAST(ingest_order AS VARCHAR) AS ingest_order, sid, name FROM raw_charges
QUALIFY row_number() OVER (PARTITION BY casnbr ORDER BY ingest_order DESC, sid DESC, name DESC) = 1""")
query("parse_dates", "SELECT casnbr, casfildat, date_of_birth, count(*) AS n FROM dated_charges GROUP BY ALL")
query("filter_names", "SELECT casnbr, name FROM raw_cases WHERE name <> '' AND contains(name, ' ')")
query("normalise_missing", """
SELECT casnbr, nullif(sid, 'M') AS sid, CASE WHEN race = 'NULL' THEN '' ELSE race END AS race FROM raw_cases""")
query("filter_ids", """
SELECT casnbr, CAST(TRY_CAST(sid AS DOUBLE) AS BIGINT) AS sid, count(*) AS n FROM raw_charges
WHERE TRY_CAST(sid AS DOUBLE) > 100 GROUP BY ALL""")
query("first_per_case", """
SELECT sid, casnbr, name, casfildat, date_of_birth, ingest_order FROM usable_charges
QUALIFY row_number() OVER (PARTITION BY sid, casnbr
  ORDER BY ingest_order, casfildat NULLS FIRST, name, dob, sex, race, date_of_birth NULLS FIRST) = 1""")
query("dense_rowid", "SELECT rowid, sid, casnbr FROM numbered")
query("parse_name", "SELECT rowid, name, last_name, first_name, middle_name FROM named")
query("filter_missing_names", "SELECT rowid, last_name, first_name FROM cases")
query("age_at_event", "SELECT rowid, casfildat, date_of_birth, age FROM cases")
query("preprocess", "SELECT * FROM persons")
query("extract_lineage", "SELECT rowid, lineage FROM persons WHERE lineage IS NOT NULL")
query("strip_lineage", "SELECT rowid, middle_name, middle_initial FROM persons")
query("date_parts", """
SELECT rowid, CAST(age_in_2020 AS DOUBLE) AS age_in_2020, CAST(year(date_of_birth) AS DOUBLE) AS yob,
       strftime(date_of_birth, '%m') AS mob, strftime(date_of_birth, '%d') AS dob
FROM persons""")

# -- profiling ------------------------------------------------------------------------

query("records_per_person", "SELECT sid, count(*) AS n_records FROM persons GROUP BY sid")
query("share_singletons", """
SELECT round(avg(CASE WHEN n_records = 1 THEN 1.0 ELSE 0.0 END), 9) AS share_singletons FROM person_stats""")
query("stat_columns", """
SELECT rowid, sid, name_dob, sid_name_dob, n_records, n_uq_namedob, n_records_per_sid_name_dob,
       any_non_exact_match, all_non_exact_match FROM profiled""")
step("size_counts", "SELECT n_records, count(*) AS n FROM person_stats GROUP BY n_records")
query("cluster_size_dist", """
SELECT n_records AS cluster_size, n AS n_sids, round_even(n / (sum(n) OVER ()), 3) AS share FROM size_counts""")
query("cluster_size_cutoff", """
SELECT max(n_records) AS max_cluster_size FROM (
  SELECT n_records, (sum(n) OVER (ORDER BY n_records)) / (sum(n) OVER ()) AS upto FROM size_counts) WHERE upto < 0.99""")
query("entity_class", "SELECT DISTINCT sid, entity_class FROM classed")
step("collapsed", """
SELECT rowid, first_name, last_name, date_of_birth, age_in_2020, middle_name, middle_initial, lineage, race, sex, sid,
       uid_sid, name_dob
FROM classed WHERE entity_class = 'mixed'
QUALIFY row_number() OVER (PARTITION BY sid, first_name, last_name, date_of_birth ORDER BY rowid) = 1""")
query("collapse_mixed", """
SELECT rowid, sid, name_dob, count(*) OVER (PARTITION BY sid) AS n_records,
       count(*) OVER (PARTITION BY sid) AS n_uq_namedob, 1 AS all_non_exact_match FROM collapsed""")

# -- roles, exact-key edges, clusters -------------------------------------------------

step("roled", """
SELECT *, CASE WHEN CASE WHEN n_records > 1 THEN rowid = min(rowid) OVER (PARTITION BY sid) ELSE rowid % 3 = 0 END
          THEN 'experiment_evaluation' ELSE 'admin_evaluation' END AS dataset
FROM profiled""")
_STAR = """
SELECT min(rowid) OVER (PARTITION BY {key}) AS rowid1, rowid AS rowid2 FROM roled
WHERE {known} QUALIFY rowid1 < rowid2"""
step("edges", _STAR.format(key="last_name, date_of_birth", known="date_of_birth IS NOT NULL") + " UNION "
     + _STAR.format(key="first_name, middle_initial, date_of_birth",
                    known="middle_initial IS NOT NULL AND date_of_birth IS NOT NULL"))
step("both_ways", "SELECT rowid1 AS a, rowid2 AS b FROM edges UNION ALL SELECT rowid2, rowid1 FROM edges")
step("reached", """
SELECT DISTINCT a AS rowid, a AS root FROM both_ways
UNION SELECT w.b, r.root FROM reached r JOIN both_ways w ON w.a = r.rowid WHERE r.root < w.b""")
step("components", "SELECT rowid, min(root) AS cluster_id FROM reached GROUP BY rowid")
step("linked", """
SELECT r.rowid, r.sid, r.dataset, r.date_of_birth,
       coalesce(c.cluster_id, CASE WHEN r.dataset = 'admin_evaluation' THEN -2 ELSE -1 END) AS cluster_id
FROM roled r LEFT JOIN components c USING (rowid)""")

query("distinct_pairs", "SELECT rowid1, rowid2 FROM edges")
query("connected_components", "SELECT rowid, cluster_id FROM components")
query("assign_clusters", "SELECT * FROM linked")

# -- evaluation -----------------------------------------------------------------------

step("exp", "SELECT *, 1 AS run FROM linked WHERE dataset = 'experiment_evaluation'")
step("adm", "SELECT *, 1 AS run FROM linked WHERE dataset = 'admin_evaluation'")


def metric_steps(prefix: str, exp: str, adm: str, spec: str) -> None:
    """Steps {prefix}any, {prefix}corr_r, .. with the metrics of each `spec` value."""
    step(f"{prefix}flags", f"""
SELECT e.{spec}, e.rowid, e.sid, e.cluster_id,
  EXISTS (SELECT 1 FROM {adm} a WHERE a.{spec} = e.{spec} AND a.sid = e.sid) AS expected,
  EXISTS (SELECT 1 FROM {adm} a WHERE a.{spec} = e.{spec} AND a.cluster_id = e.cluster_id) AS made FROM {exp} e""")
    step(f"{prefix}any", f"""
SELECT {spec}, avg(CAST(made AS INT)) FILTER (expected) AS tpr_any, avg(CAST(expected AS INT)) FILTER (made) AS prc_any,
  avg(CAST(NOT made AS INT)) FILTER (NOT expected) AS tnr_any, avg(CAST(expected = made AS INT)) AS acc_any
FROM {prefix}flags GROUP BY {spec}""")
    step(f"{prefix}corr_r", f"""
SELECT {spec}, avg(ok) AS tpr_corr FROM (
  SELECT e.{spec}, e.sid, min(CAST(e.cluster_id = a.cluster_id AS INT)) AS ok
  FROM {exp} e JOIN {adm} a ON a.{spec} = e.{spec} AND a.sid = e.sid GROUP BY e.{spec}, e.sid) GROUP BY {spec}""")
    step(f"{prefix}corr_p", f"""
SELECT {spec}, avg(ok) AS prc_corr FROM (
  SELECT e.{spec}, e.sid, min(CAST(e.sid = a.sid AS INT)) AS ok
  FROM {exp} e JOIN {adm} a ON a.{spec} = e.{spec} AND a.cluster_id = e.cluster_id GROUP BY e.{spec}, e.sid)
GROUP BY {spec}""")
    step(f"{prefix}pair_r", f"""
SELECT e.{spec}, avg(CAST(e.cluster_id = a.cluster_id AS INT)) AS tpr_pair
FROM {exp} e JOIN {adm} a ON a.{spec} = e.{spec} AND a.sid = e.sid GROUP BY e.{spec}""")
    step(f"{prefix}pair_p", f"""
SELECT e.{spec}, avg(CAST(e.sid = a.sid AS INT)) AS prc_pair
FROM {exp} e JOIN {adm} a ON a.{spec} = e.{spec} AND a.cluster_id = e.cluster_id GROUP BY e.{spec}""")
    step(f"{prefix}pair_n", f"""
SELECT a.{spec}, avg(CAST(NOT EXISTS (SELECT 1 FROM {exp} e WHERE e.{spec} = a.{spec} AND e.cluster_id = a.cluster_id)
  AS INT)) AS tnr_pair
FROM {adm} a WHERE NOT EXISTS (SELECT 1 FROM {exp} e WHERE e.{spec} = a.{spec} AND e.sid = a.sid) GROUP BY a.{spec}""")
    step(f"{prefix}summary", f"""
SELECT {spec}, tpr_any, prc_any, tnr_any, (1 - tnr_any) + (1 - tpr_any) AS error_any, acc_any, tpr_corr, prc_corr,
  tpr_pair, prc_pair, tnr_pair, (1 - tnr_pair) + (1 - tpr_pair) AS error_pair
FROM {prefix}any LEFT JOIN {prefix}corr_r USING ({spec}) LEFT JOIN {prefix}corr_p USING ({spec})
  LEFT JOIN {prefix}pair_r USING ({spec}) LEFT JOIN {prefix}pair_p USING ({spec}) LEFT JOIN {prefix}pair_n USING ({spec})""")


def rounded(columns: list[str], digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


ANY = ["tpr_any", "prc_any", "tnr_any", "error_any"]
METRICS = [*ANY, "acc_any", "tpr_corr", "prc_corr", "tpr_pair", "prc_pair", "tnr_pair", "error_pair"]

metric_steps("one_", "exp", "adm", "run")
query("any_link", f"SELECT {rounded(['tpr_any', 'prc_any', 'tnr_any', 'acc_any'])} FROM one_any")
query("correct_links_recall", f"SELECT {rounded(['tpr_corr'])} FROM one_corr_r")
query("correct_links_precision", f"SELECT {rounded(['prc_corr'])} FROM one_corr_p")
query("pair_recall", f"SELECT {rounded(['tpr_pair'])} FROM one_pair_r")
query("pair_precision", f"SELECT {rounded(['prc_pair'])} FROM one_pair_p")
query("pair_tnr", f"SELECT {rounded(['tnr_pair'])} FROM one_pair_n")
query("exact_key_linkage", f"SELECT {rounded(METRICS)} FROM one_summary")

# -- sampling and study design --------------------------------------------------------

step("exact_rows", "SELECT rowid, sid FROM classed WHERE entity_class = 'exact'")
step("different_rows", """
SELECT rowid, sid FROM classed WHERE entity_class = 'different' UNION ALL SELECT rowid, sid FROM collapsed""")
step("plain_different_rows", "SELECT rowid, sid FROM classed WHERE entity_class = 'different'")


def truncation_steps(prefix: str, rows: str, limit: str, bins: int, limits: str = "(SELECT 1)") -> None:
    step(f"{prefix}_sizes", f"SELECT sid, count(*) AS n FROM {rows} GROUP BY sid")
    step(f"{prefix}_over", f"""
SELECT sid, n, row_number() OVER (ORDER BY md5('3:bin:' || sid), sid) AS turn
FROM {prefix}_sizes, {limits} WHERE n > {limit}""")
    step(f"{prefix}_bins", f"""
SELECT n AS size, count(*) AS c FROM {prefix}_sizes, {limits} WHERE n <= {limit} AND n > {limit} - {bins} GROUP BY n""")
    step(f"{prefix}_quota", f"""
SELECT size, c, round_even((SELECT count(*) FROM {prefix}_over) * (c / (sum(c) OVER ())), 0) AS q,
       row_number() OVER (ORDER BY c DESC, size) AS place, count(*) OVER () AS places FROM {prefix}_bins""")
    step(f"{prefix}_border", f"""
SELECT size, CASE WHEN place = places THEN 1e18 ELSE sum(q) OVER (ORDER BY place) END AS upto,
       CASE WHEN place = 1 THEN 0 ELSE (sum(q) OVER (ORDER BY place)) - q END AS after FROM {prefix}_quota""")
    step(f"{prefix}_cut", f"""
SELECT r.rowid, r.sid FROM {rows} r LEFT JOIN {prefix}_over o USING (sid)
LEFT JOIN {prefix}_border b ON o.turn > b.after AND o.turn <= b.upto
QUALIFY o.sid IS NULL OR row_number() OVER (PARTITION BY r.sid ORDER BY md5('3:keep:' || r.rowid), r.rowid) <= b.size""")


truncation_steps("exact", "exact_rows", "5", 4)
truncation_steps("different", "different_rows", "5", 2)
query("truncate_clusters", "SELECT rowid, sid FROM exact_cut")
step("plain_limit", """
SELECT max(n) AS top FROM (SELECT n, (sum(k) OVER (ORDER BY n)) / (sum(k) OVER ()) AS upto FROM (
  SELECT n, count(*) AS k FROM (SELECT sid, count(*) AS n FROM plain_different_rows GROUP BY sid) GROUP BY n)) WHERE upto < 0.99""")
truncation_steps("plain", "plain_different_rows", "top", 2, "plain_limit")
query("size_policy", """
SELECT rowid, sid, 'different' AS entity_class FROM plain_cut UNION ALL
SELECT rowid, sid, 'exact' FROM exact_rows
WHERE sid IN (SELECT sid FROM exact_rows GROUP BY sid HAVING count(*) <= (SELECT top FROM plain_limit))""")
step("pool_rows", """
SELECT k.* FROM keyed k WHERE rowid IN (SELECT rowid FROM classed WHERE entity_class = 'singleton')
OR rowid IN (SELECT rowid FROM exact_cut) OR rowid IN (SELECT rowid FROM different_cut)""")
step("pool_persons", """
SELECT sid, count(DISTINCT rowid) AS n_records, count(DISTINCT name_dob) AS n_uq_namedob FROM pool_rows GROUP BY sid""")
step("pool_spellings", """
SELECT sid, name_dob, count(DISTINCT rowid) AS n_records_per_sid_name_dob FROM pool_rows
WHERE name_dob IS NOT NULL GROUP BY sid, name_dob""")
step("pool", _STATS.format(keyed="pool_rows", persons="pool_persons", spellings="pool_spellings"))
query("sampling_pool", """
SELECT rowid, sid, name_dob, sid_name_dob, n_records, n_uq_namedob, n_records_per_sid_name_dob,
       any_non_exact_match, all_non_exact_match FROM pool""")
step("split", """
SELECT sid, entity_class, n_records,
  CASE WHEN row_number() OVER (PARTITION BY entity_class, n_records ORDER BY md5('3:split:' || sid), sid)
    <= round_even((count(*) OVER (PARTITION BY entity_class, n_records)) / 2, 0) THEN 'training' ELSE 'evaluation' END AS side
FROM (SELECT DISTINCT sid, n_records, CASE WHEN n_records = 1 THEN 'singleton' WHEN n_uq_namedob = 1 THEN 'exact'
        WHEN n_uq_namedob = n_records THEN 'different' ELSE 'mixed' END AS entity_class FROM pool)""")
query("train_eval_split", "SELECT * FROM split")
step("ranked", """
SELECT *, row_number() OVER (PARTITION BY entity_class, n_records, side ORDER BY md5('3:sample:' || sid), sid) AS place
FROM split""")
step("target", "SELECT * FROM (VALUES (1, 0.499), (2, 0.4), (3, 0.06), (4, 0.03), (5, 0.011)) t(s, share)")
step("wanted_sizes", "SELECT * FROM (VALUES (5000), (50000), (200000)) t(spec_n)")
step("share_list", "SELECT * FROM (VALUES (0.5::DOUBLE), (0.25::DOUBLE)) t(share_exact)")
step("base", """
SELECT s, share::DOUBLE AS share, trunc(share::DOUBLE * (SELECT count(DISTINCT sid) FROM pool)) AS n FROM target""")
step("size_total", """
SELECT spec_n, sum(round_even(round_even(spec_n::DOUBLE / (SELECT sum(s * n) FROM base) * n * s, 0) / s, 0)) AS persons
FROM wanted_sizes, base GROUP BY spec_n""")
step("shifted", """
SELECT spec_n, s, share * persons
  + coalesce(lag(trunc(500.0::DOUBLE * share)) OVER (PARTITION BY spec_n ORDER BY s), 0)
  - CASE WHEN s < 5 THEN trunc(500.0::DOUBLE * share) ELSE 0 END AS v
FROM size_total, base""")
step("adjusted", """
SELECT spec_n, s, trunc(v / (sum(v) OVER (PARTITION BY spec_n)) * (SELECT count(DISTINCT sid) FROM pool)) AS n FROM shifted""")
step("quotas", """
SELECT spec_n, s, CAST(round_even(round_even((spec_n + 500.0::DOUBLE) / (sum(s * n) OVER (PARTITION BY spec_n)) * n * s, 0) / s, 0)
  AS BIGINT) AS n_sids FROM adjusted""")
query("quota_table", "SELECT spec_n, s AS cluster_size, n_sids FROM quotas")
step("offered", """
SELECT spec_n, share_exact, side, entity_class, s, n AS p,
  CASE WHEN entity_class = 'singleton' THEN CASE WHEN s = 1 THEN n_sids ELSE 0 END WHEN s = 1 THEN 0
       WHEN entity_class = 'exact' THEN round_even(share_exact * n_sids, 0)
       ELSE round_even((1 - share_exact) * n_sids, 0) END AS w
FROM (SELECT entity_class, side, n_records, count(*) AS n FROM ranked GROUP BY ALL) a
JOIN quotas q ON q.s = a.n_records, share_list""")
step("wide", """
SELECT spec_n, share_exact, side, entity_class, """ + ", ".join(
    f"coalesce(sum(p) FILTER (s = {i}), 0) AS p{i}, "
    f"coalesce(sum(least(p, w)) FILTER (s = {i}), 0) AS t{i}, "
    f"coalesce(sum(greatest(w - p, 0)) FILTER (s = {i}), 0) AS short{i}" for i in range(1, 6)) + """
FROM offered GROUP BY ALL""")
step("fill3", "SELECT *, least(p2 - t2, ceil(short3 * 3 / 2)) AS b32 FROM wide")
step("fill4", "SELECT *, least(p3 - t3, ceil(short4 * 4 / 3)) AS b43 FROM fill3")
step("fill4b", "SELECT *, least(p2 - t2 - b32, ceil(greatest(short4 - b43, 0) * 3 / 2)) AS b42 FROM fill4")
step("fill5", "SELECT *, least(p4 - t4, ceil(short5 * 5 / 4)) AS b54 FROM fill4b")
step("fill5b", "SELECT *, least(p3 - t3 - b43, ceil(greatest(short5 - b54, 0) * 4 / 3)) AS b53 FROM fill5")
step("fill5c", """
SELECT *, least(p2 - t2 - b32 - b42, ceil(greatest(short5 - b54 - b53, 0) * 3 / 2)) AS b52 FROM fill5b""")
step("takes", " UNION ALL ".join(
    f"SELECT spec_n, share_exact, side, entity_class, {i} AS s, {take} AS take FROM fill5c" for i, take in
    ((1, "t1"), (2, "t2 + b32 + b42 + b52"), (3, "t3 + b43 + b53"), (4, "t4 + b54"), (5, "t5"))))
step("chosen", """
SELECT CAST(spec_n AS VARCHAR) || '__' || CAST(CAST(share_exact * 100 AS INT) AS VARCHAR) AS spec, share_exact,
       side, entity_class, sid
FROM ranked JOIN takes USING (side, entity_class) WHERE takes.s = ranked.n_records AND place <= take""")
query("quota_sample", "SELECT spec, side, entity_class, sid FROM chosen")
step("admin_rows", "SELECT c.spec, c.side, p.rowid, p.sid FROM pool p JOIN chosen c USING (sid)")
query("admin_datasets", "SELECT * FROM admin_rows")
step("eligible", "SELECT rowid, sid FROM pool WHERE n_records = 1 AND sid NOT IN (SELECT sid FROM chosen)")
query("eligible_singletons", "SELECT * FROM eligible")
step("moved", """
SELECT spec, side, rowid FROM (SELECT DISTINCT spec, side FROM chosen),
  (SELECT rowid FROM eligible QUALIFY row_number() OVER (ORDER BY md5('3:fresh:' || rowid), rowid) <= 500)
UNION ALL SELECT spec, side, rowid FROM (
  SELECT spec, side, entity_class, share_exact, min(p.rowid) AS rowid FROM chosen c JOIN pool p USING (sid)
  WHERE entity_class IN ('exact', 'different') GROUP BY spec, side, entity_class, share_exact, sid)
QUALIFY row_number() OVER (PARTITION BY spec, side, entity_class ORDER BY md5('3:move:' || rowid), rowid)
  <= trunc(500 * CASE WHEN entity_class = 'exact' THEN share_exact ELSE 1 - share_exact END)""")
query("experiment_datasets", "SELECT * FROM moved")
step("datasets", """
SELECT spec, 'admin_' || side AS dataset, rowid FROM admin_rows a
WHERE NOT EXISTS (SELECT 1 FROM moved m WHERE m.spec = a.spec AND m.side = a.side AND m.rowid = a.rowid)
UNION ALL SELECT spec, 'experiment_' || side, rowid FROM moved""")
query("build_datasets", "SELECT spec, dataset, rowid, sid, name_dob FROM datasets JOIN pool USING (rowid)")
query("write_datasets", """
SELECT spec, dataset, rowid, sid, CASE WHEN dataset = 'admin_training' THEN uid_sid END AS uid_sid, first_name, lineage
FROM datasets JOIN pool USING (rowid)""")
query("dataset_scan", """
SELECT spec, rowid, date_of_birth, age_in_2020 FROM datasets JOIN pool USING (rowid) WHERE dataset = 'admin_evaluation'""")
query("run_grid", """
WITH sized AS (
  SELECT CAST(split_part(spec, '__', 1) AS INT) AS ss_train, CAST(split_part(spec, '__', 2) AS INT) AS em_train,
         count(*) FILTER (dataset = 'admin_evaluation') AS n_admin,
         count(*) FILTER (dataset = 'experiment_evaluation') AS n_experiment FROM datasets GROUP BY ALL),
its AS (SELECT unnest(range(10)) AS model_iter), frameworks AS (SELECT unnest(['deduplication', 'record_linkage']) AS framework)
SELECT * FROM (
  SELECT 'supervised' AS arm, ss_train, em_train, '' AS framework, 0 AS budget, 0 AS sample_size, model_iter, n_admin, n_experiment
  FROM sized, its
  UNION ALL SELECT 'unsupervised', ss_train, em_train, framework, 0, 0, model_iter, n_admin, n_experiment FROM sized, its, frameworks
  UNION ALL SELECT 'active', ss_train, em_train, framework, budget, sample_size, model_iter, n_admin, n_experiment
  FROM sized, its, frameworks, (SELECT unnest([20, 40, 80, 200, 500, 1000]) AS budget),
    (SELECT unnest([1500, 15000, 150000, 300000]) AS sample_size)
  WHERE framework = 'deduplication' OR sample_size IN (15000, 150000))
WHERE em_train = 50""")

# -- blocking and candidates ----------------------------------------------------------

COMPARED = "first_name, last_name, date_of_birth, age_in_2020, middle_initial, race, sex"
step("prof", f"""
SELECT {COMPARED}, min(sid) AS sid, dataset, min(rowid) AS rowid, count(*) AS copies, year(date_of_birth) AS yob
FROM roled GROUP BY {COMPARED}, dataset""")
step("prof_e", "SELECT * FROM prof WHERE dataset = 'experiment_evaluation'")
step("prof_a", "SELECT * FROM prof WHERE dataset = 'admin_evaluation'")
_BOTH = ", ".join(f"a.{c} AS {c}1, b.{c} AS {c}2" for c in
                  (COMPARED + ", sid, dataset, rowid, copies, yob").split(", "))
_KEYS = """((a.last_name = b.last_name AND a.yob = b.yob)
  OR (a.first_name = b.first_name AND a.middle_initial = b.middle_initial AND a.yob = b.yob)
  OR a.date_of_birth = b.date_of_birth)"""
step("cand", f"SELECT {_BOTH} FROM prof_e a JOIN prof_a b ON {_KEYS}")


def _edit(c: str) -> str:
    a, b = f"CAST({c}1 AS VARCHAR)", f"CAST({c}2 AS VARCHAR)"
    return (f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN 1.0 ELSE "
            f"1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})) END")


_SIMS = f"""
  {_edit('first_name')} AS first_name_sim, {_edit('last_name')} AS last_name_sim,
  abs(date_of_birth1 - date_of_birth2) AS dob_days, {_edit('date_of_birth')} AS dob_sim,
  CAST(middle_initial1 = middle_initial2 AS INT) AS mi_equal, CAST(race1 = race2 AS INT) AS race_equal,
  CAST(sex1 = sex2 AS INT) AS sex_equal, abs(age_in_20201 - age_in_20202) AS age_diff"""
step("sims", f"SELECT rowid1, rowid2, {_SIMS} FROM cand")
step("scored", "SELECT *, round((first_name_sim + last_name_sim + dob_sim) / 3, 6) AS score FROM sims")
step("window_members", """
SELECT CAST(yob AS VARCHAR) AS block, 'A' AS side, rowid, dataset, yob, copies FROM prof_e
UNION ALL SELECT CAST(unnest([yob - 1, yob, yob + 1]) AS VARCHAR), 'B', rowid, dataset, yob, copies FROM prof_a""")
query("block_year_window", "SELECT block, side, rowid FROM window_members")

step("last_names", """
SELECT last_name, w, row_number() OVER (ORDER BY last_name) AS place
FROM (SELECT last_name, count(*) AS w FROM roled WHERE last_name IS NOT NULL GROUP BY last_name)""")
step("name_centres", """
SELECT 0 AS turn, max(place) / 4 AS lower, 3 * max(place) / 4 AS upper FROM last_names
UNION ALL SELECT turn + 1, sum(place * w) FILTER (place <= (lower + upper) / 2) / sum(w) FILTER (place <= (lower + upper) / 2),
  sum(place * w) FILTER (place > (lower + upper) / 2) / sum(w) FILTER (place > (lower + upper) / 2)
FROM name_centres, last_names WHERE turn < 50 GROUP BY turn, lower, upper""")
step("name_ranges", """
SELECT last_name, CAST(place > (lower + upper) / 2 AS INT) AS name_cluster FROM last_names, name_centres WHERE turn = 50""")
query("block_name_ranges", "SELECT * FROM name_ranges")
step("range_members", """
SELECT name_cluster || '.' || block AS block, side, m.rowid, m.dataset, m.yob, m.copies
FROM window_members m JOIN prof p ON p.rowid = m.rowid JOIN name_ranges USING (last_name)""")
step("block_sizes", "SELECT block, count(*) FILTER (side = 'A') AS n_a FROM range_members GROUP BY block")
step("members", """
SELECT DISTINCT CASE WHEN n_a <= 4 THEN 'small' ELSE m.block END AS block, side, rowid, dataset, yob, copies
FROM range_members m JOIN block_sizes USING (block)""")
query("block_range_members", "SELECT block, side, rowid FROM range_members")
query("merge_small_blocks", "SELECT block, side, rowid FROM members")
query("block_listing", "SELECT block, dataset, rowid, yob FROM members")

step("names", """
SELECT first_name || ' ' || last_name AS name, count(*) AS n_name FROM persons
WHERE first_name IS NOT NULL AND last_name IS NOT NULL GROUP BY ALL""")
step("terms", """
SELECT name, gram, count(*) AS tf FROM (
  SELECT name, substr('^' || name || '$', unnest(range(1, length(name) + 2)), 2) AS gram FROM names) GROUP BY ALL""")
step("weights", """
SELECT name, gram, tf * (ln((SELECT count(*) FROM names) / df) + 1) AS w
FROM terms JOIN (SELECT gram, count(*) AS df FROM terms GROUP BY gram) USING (gram)""")
step("units", "SELECT name, gram, w / sqrt(sum(w * w) OVER (PARTITION BY name)) AS w FROM weights")
step("name_pairs", """
SELECT name1, name2, cosine FROM (
  SELECT a.name AS name1, b.name AS name2, round(sum(a.w * b.w), 9) AS cosine
  FROM units a JOIN units b ON a.gram = b.gram AND a.name < b.name GROUP BY ALL) p
JOIN names x ON x.name = name1 JOIN names y ON y.name = name2
WHERE cosine >= round(0.55 + 0.05 * greatest(x.n_name, y.n_name) / (SELECT max(n_name) FROM names), 9)""")
query("block_cosine", "SELECT * FROM name_pairs")
step("spelled", """
SELECT first_name || ' ' || last_name AS name, date_of_birth, age_in_2020, min(rowid) AS rowid FROM persons
WHERE first_name IS NOT NULL AND last_name IS NOT NULL GROUP BY ALL""")
step("alike", """
SELECT a.rowid AS r1, b.rowid AS r2, a.date_of_birth AS d1, b.date_of_birth AS d2, a.age_in_2020 AS g1, b.age_in_2020 AS g2
FROM spelled a JOIN spelled b ON a.name = b.name AND a.rowid < b.rowid
UNION ALL
SELECT a.rowid, b.rowid, a.date_of_birth, b.date_of_birth, a.age_in_2020, b.age_in_2020
FROM name_pairs p JOIN spelled a ON a.name = p.name1 JOIN spelled b ON b.name = p.name2""")
query("block_dob_edit", """
SELECT least(r1, r2) AS rowid1, greatest(r1, r2) AS rowid2 FROM alike
WHERE levenshtein(CAST(d1 AS VARCHAR), CAST(d2 AS VARCHAR)) <= 3""")
query("block_age_backup", """
SELECT least(r1, r2) AS rowid1, greatest(r1, r2) AS rowid2 FROM alike
WHERE CASE WHEN year(d1) % 7 = 0 OR year(d2) % 7 = 0 THEN abs(g1 - g2) <= 3
      ELSE levenshtein(CAST(d1 AS VARCHAR), CAST(d2 AS VARCHAR)) <= 3 END""")
query("candidate_sample", """
SELECT rowid1, rowid2 FROM cand
QUALIFY row_number() OVER (ORDER BY md5('3:candidates:' || rowid1 || '-' || rowid2), rowid1 || '-' || rowid2) <= 1500""")
query("candidate_stats", """
SELECT count(*) FILTER (sid1 = sid2) AS cp_1s, count(*) FILTER (sid1 = sid2 AND
  (first_name1 <> first_name2 OR last_name1 <> last_name2 OR date_of_birth1 <> date_of_birth2)) AS cp_1s__nem FROM cand""")
query("canonical_pairs", "SELECT rowid1, rowid2 FROM edges")
query("stack_roles", "SELECT rowid, sid, dataset FROM roled")

# -- comparison -----------------------------------------------------------------------

query("compare_pairs", """
SELECT rowid1, rowid2, round(first_name_sim, 9) AS first_name_sim, round(last_name_sim, 9) AS last_name_sim, dob_days,
       round(dob_sim, 9) AS dob_sim, mi_equal, race_equal, sex_equal, age_diff FROM sims""")
step("declared_pairs", """
SELECT a.rowid AS rowid1, b.rowid AS rowid2, a.first_name AS first_name1, b.first_name AS first_name2,
       a.last_name AS last_name1, b.last_name AS last_name2, a.date_of_birth AS d1, b.date_of_birth AS d2,
       a.age_in_2020 AS g1, b.age_in_2020 AS g2, a.middle_initial AS m1, b.middle_initial AS m2,
       a.lineage AS l1, b.lineage AS l2, a.sex AS s1, b.sex AS s2, a.race AS r1, b.race AS r2
FROM roled a JOIN roled b ON a.last_name = b.last_name AND a.date_of_birth = b.date_of_birth
WHERE a.dataset = 'experiment_evaluation' AND b.dataset = 'admin_evaluation'""")
query("compare_config", f"""
SELECT rowid1, rowid2, round({_edit('first_name')}, 9) AS first_name, round({_edit('last_name')}, 9) AS last_name,
       abs(d1 - d2) AS dob, abs(g1 - g2) AS age, CAST(m1 = m2 AS INT) AS middle_initial, CAST(l1 = l2 AS INT) AS suffix,
       CAST(s1 = s2 AS INT) AS gender, CAST(r1 = r2 AS INT) AS race, CAST(NULL AS INT) AS uid_sid FROM declared_pairs""")
query("value_checks", """
SELECT casnbr AS rowid, date_of_birth AS dob, CASE WHEN sex IN ('M', 'F') THEN sex END AS gender,
       CAST(date_of_birth IS NULL AS INT) + CAST(sex NOT IN ('M', 'F') AS INT) AS n_invalid, count(*) AS n
FROM dated_charges GROUP BY ALL""")


def _graded(c: str) -> str:
    s = f"jaro_winkler_similarity(CAST({c}1 AS VARCHAR), CAST({c}2 AS VARCHAR))"
    return f"CASE WHEN {s} >= 0.94 THEN 2 WHEN {s} >= 0.88 THEN 1 WHEN {s} IS NOT NULL THEN 0 END"


def _same(a: str, b: str) -> str:
    return f"CASE WHEN {a} = {b} THEN 2 WHEN {a} <> {b} THEN 0 END"


_LEVELS = f"""
  {_graded('first_name')} AS g_first, {_graded('last_name')} AS g_last, {_graded('date_of_birth')} AS g_dob,
  {_same('middle_initial1', 'middle_initial2')} AS g_mi, {_same('race1', 'race2')} AS g_race,
  {_same('sex1', 'sex2')} AS g_sex, {_same('month(date_of_birth1)', 'month(date_of_birth2)')} AS g_month,
  {_same('day(date_of_birth1)', 'day(date_of_birth2)')} AS g_day"""
query("agreement_levels", f"SELECT rowid1, rowid2, {_LEVELS} FROM cand")
step("block_cand", f"""
SELECT m.block, {_BOTH} FROM members m JOIN members n ON n.block = m.block AND m.side = 'A' AND n.side = 'B'
JOIN prof a ON a.rowid = m.rowid JOIN prof b ON b.rowid = n.rowid
WHERE a.last_name = b.last_name OR (a.first_name = b.first_name AND a.middle_initial = b.middle_initial)
  OR a.date_of_birth = b.date_of_birth""")
step("block_patterns", f"""
SELECT block, g_first, g_last, g_dob, g_mi, g_race, g_sex, g_month, g_day, sum(c) AS n
FROM (SELECT block, copies1 * copies2 AS c, {_LEVELS} FROM block_cand) GROUP BY ALL""")
step("block_rest", """
SELECT block, a * b - coalesce((SELECT sum(n) FROM block_patterns p WHERE p.block = t.block), 0) AS n FROM (
  SELECT block, coalesce(sum(copies) FILTER (side = 'A'), 0) AS a, coalesce(sum(copies) FILTER (side = 'B'), 0) AS b
  FROM members GROUP BY block) t""")
query("pattern_counts", """
SELECT block, g_first, g_last, g_dob, g_mi, g_race, g_sex, g_month, g_day, CAST(n AS BIGINT) AS n_pairs FROM block_patterns
UNION ALL SELECT block, NULL, 0, 0, NULL, NULL, NULL, NULL, NULL, CAST(n AS BIGINT) FROM block_rest WHERE n > 0""")
step("member_values", " UNION ALL ".join(
    f"SELECT block, side, m.copies, 'g_{f}' AS field, CAST({v} AS VARCHAR) AS value FROM members m JOIN prof USING (rowid)"
    for f, v in (("first", "first_name"), ("last", "last_name"), ("dob", "date_of_birth"), ("mi", "middle_initial"),
                 ("race", "race"), ("sex", "sex"), ("month", "month(date_of_birth)"), ("day", "day(date_of_birth)"))))
step("value_counts", """
SELECT block, field, value, coalesce(sum(copies) FILTER (side = 'A'), 0) AS a, coalesce(sum(copies) FILTER (side = 'B'), 0) AS b
FROM member_values WHERE value IS NOT NULL GROUP BY ALL""")
step("date_levels", """
SELECT x.block, x.a * y.b AS n, jaro_winkler_similarity(x.value, y.value) AS s
FROM value_counts x JOIN value_counts y ON x.block = y.block WHERE x.field = 'g_dob' AND y.field = 'g_dob' AND x.a > 0 AND y.b > 0""")
query("field_totals", """
SELECT block, field, CAST(sum(a * b) AS BIGINT) AS n_full, 0 AS n_partial, CAST(sum(a) * sum(b) AS BIGINT) AS n_known
FROM value_counts WHERE field <> 'g_dob' GROUP BY block, field HAVING sum(a) * sum(b) > 0
UNION ALL SELECT block, 'g_dob', CAST(coalesce(sum(n) FILTER (s >= 0.94), 0) AS BIGINT),
  CAST(coalesce(sum(n) FILTER (s >= 0.88 AND s < 0.94), 0) AS BIGINT), CAST(sum(n) AS BIGINT) FROM date_levels GROUP BY block""")
# one table: all pairs of profiles that meet in a block are listed, each with the lowest block it meets in
step("one_homes", """
SELECT name_cluster, yob, CASE WHEN sum(copies) <= 8 THEN 'small' ELSE name_cluster || '.' || yob END AS home
FROM prof JOIN name_ranges USING (last_name) WHERE yob IS NOT NULL GROUP BY name_cluster, yob""")
step("one_placed", "SELECT p.*, name_cluster, home FROM prof p JOIN name_ranges USING (last_name) JOIN one_homes USING (name_cluster, yob)")
step("one_members", """
SELECT home AS block, 'A' AS side, rowid, home FROM one_placed
UNION SELECT h.home, 'B', rowid, p.home FROM one_placed p JOIN one_homes h ON h.name_cluster = p.name_cluster AND abs(h.yob - p.yob) <= 1""")
query("one_table_members", "SELECT * FROM one_members")
step("one_met", """
SELECT least(m.rowid, n.rowid) AS rowid1, greatest(m.rowid, n.rowid) AS rowid2, min(m.block) AS block
FROM one_members m JOIN one_members n ON m.block = n.block AND m.side = 'A' AND n.side = 'B' AND m.rowid <> n.rowid GROUP BY 1, 2""")
step("one_pairs", f"""
SELECT t.block, a.copies * b.copies AS n, {_BOTH} FROM one_met t JOIN prof a ON a.rowid = rowid1 JOIN prof b ON b.rowid = rowid2
UNION ALL SELECT a.home, a.copies * (a.copies - 1) // 2, {_BOTH} FROM one_placed a JOIN prof b USING (rowid) WHERE a.copies > 1""")
step("one_shared", """
SELECT * FROM one_pairs WHERE last_name1 = last_name2 OR date_of_birth1 = date_of_birth2
  OR (first_name1 = first_name2 AND middle_initial1 = middle_initial2)""")
query("one_table_pairs", f"SELECT block, rowid1, rowid2, {_LEVELS} FROM one_shared WHERE rowid1 <> rowid2")
step("one_patterns", f"""
SELECT block, g_first, g_last, g_dob, g_mi, g_race, g_sex, g_month, g_day, CAST(sum(n) AS BIGINT) AS n_pairs
FROM (SELECT block, n, {_LEVELS} FROM one_shared) GROUP BY ALL""")
query("one_table_patterns", """
SELECT * FROM one_patterns UNION ALL
SELECT block, NULL, 0, 0, NULL, NULL, NULL, NULL, NULL, CAST(n_all - coalesce(n_seen, 0) AS BIGINT)
FROM (SELECT block, sum(n) AS n_all FROM one_pairs GROUP BY block)
LEFT JOIN (SELECT block, sum(n_pairs) AS n_seen FROM one_patterns GROUP BY block) USING (block)
WHERE n_all > coalesce(n_seen, 0)""")
step("one_births", """
SELECT block, date_of_birth1, date_of_birth2, sum(n) AS n FROM one_pairs
WHERE date_of_birth1 IS NOT NULL AND date_of_birth2 IS NOT NULL GROUP BY ALL""")
query("one_table_totals", " UNION ALL ".join(f"""
SELECT block, 'g_{f}' AS field, CAST(coalesce(sum(n) FILTER ({a} = {b}), 0) AS BIGINT) AS n_full, 0 AS n_partial,
  CAST(sum(n) AS BIGINT) AS n_known FROM one_pairs WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY block"""
    for f, a, b in (("first", "first_name1", "first_name2"), ("last", "last_name1", "last_name2"),
                    ("mi", "middle_initial1", "middle_initial2"), ("race", "race1", "race2"), ("sex", "sex1", "sex2"),
                    ("month", "month(date_of_birth1)", "month(date_of_birth2)"),
                    ("day", "day(date_of_birth1)", "day(date_of_birth2)"))) + f"""
UNION ALL SELECT block, 'all', CAST(sum(n) AS BIGINT), 0, CAST(sum(n) AS BIGINT) FROM one_pairs GROUP BY block
UNION ALL SELECT block, 'g_dob', CAST(coalesce(sum(n) FILTER (g = 2), 0) AS BIGINT),
  CAST(coalesce(sum(n) FILTER (g = 1), 0) AS BIGINT), CAST(sum(n) AS BIGINT)
FROM (SELECT block, n, {_graded('date_of_birth')} AS g FROM one_births) GROUP BY block""")
step("labelled", """
SELECT rowid1, rowid2, CASE WHEN sid1 = sid2 THEN 'y' ELSE 'n' END AS label,
  CAST(first_name1 = first_name2 AND last_name1 = last_name2 AND date_of_birth1 = date_of_birth2 AS INT) AS exact_match
FROM cand""")
query("truth_labels", "SELECT * FROM labelled")
query("label_balance", """
SELECT count(*) FILTER (label = 'y') AS labeled_1s, count(*) FILTER (label = 'n') AS labeled_0s,
       round((count(*) FILTER (label = 'y')) / count(*), 9) AS labeled_base_rate FROM labelled""")
query("match_rows", """
SELECT rowid1, a.sid AS sid1, a.dataset AS d1, rowid2, b.sid AS sid2, b.dataset AS d2
FROM edges JOIN roled a ON a.rowid = rowid1 JOIN roled b ON b.rowid = rowid2""")

# -- constraints and clustering -------------------------------------------------------

step("nodes", """
SELECT *, CASE WHEN role = 'ADMIN_TRAINING' THEN sid END AS uid_sid FROM (
  SELECT *, CASE WHEN dataset = 'experiment_evaluation' THEN 'EXPERIMENT'
                 WHEN ('0x' || substr(md5('3:role:' || sid), 1, 15))::BIGINT % 2 = 0 THEN 'ADMIN_TRAINING'
                 ELSE 'ADMIN_EVALUATION' END AS role FROM prof)""")
step("node_pairs", f"SELECT {_BOTH}, a.role AS role1, b.role AS role2 FROM nodes a JOIN nodes b ON a.rowid < b.rowid AND {_KEYS}")
step("node_sims", f"SELECT rowid1, rowid2, role1, role2, {_SIMS} FROM node_pairs")
step("node_edges", """
SELECT rowid1, rowid2, role1, role2, round((first_name_sim + last_name_sim + dob_sim) / 3, 6) AS phat,
       rowid1 * 1000003 + rowid2 AS original_order
FROM node_sims WHERE round((first_name_sim + last_name_sim + dob_sim) / 3, 6) >= 0.7""")
query("valid_links", """
SELECT rowid1, rowid2, NOT ((role1 = 'ADMIN_TRAINING') <> (role2 = 'ADMIN_TRAINING'))
  AND NOT (role1 = 'EXPERIMENT' AND role2 = 'EXPERIMENT') AS valid FROM node_edges""")
query("link_priority", """
SELECT rowid1, rowid2, row_number() OVER (ORDER BY phat DESC, original_order, rowid1, rowid2) AS priority FROM node_edges""")
step("node_ways", "SELECT rowid1 AS a, rowid2 AS b FROM node_edges UNION ALL SELECT rowid2, rowid1 FROM node_edges")
step("node_reached", """
SELECT DISTINCT a AS rowid, a AS root FROM node_ways
UNION SELECT w.b, r.root FROM node_reached r JOIN node_ways w ON w.a = r.rowid WHERE r.root < w.b""")
step("node_parts", """
SELECT n.*, cluster_id FROM nodes n JOIN (SELECT rowid, min(root) AS cluster_id FROM node_reached GROUP BY rowid) USING (rowid)""")
query("valid_clusters", """
SELECT cluster_id, count(*) FILTER (role = 'EXPERIMENT') <= 1 AND NOT (count(*) FILTER (role = 'ADMIN_TRAINING') > 0
  AND count(*) FILTER (role <> 'ADMIN_TRAINING') > 0) AS valid FROM node_parts GROUP BY cluster_id""")
query("unique_id_rule", "SELECT cluster_id, count(DISTINCT uid_sid) <= 1 AS valid_ids FROM node_parts GROUP BY cluster_id")
average_linkage_steps("node_mean", """
SELECT 'all' AS model, rowid1 AS a, rowid2 AS b, round((first_name_sim + last_name_sim + dob_sim) / 3, 6) AS total FROM node_sims""", 0.7)
query("partition_clusters", "SELECT rowid, cluster_id FROM node_mean_last")
query("many_to_one", """
SELECT rowid2 AS rowid1, rowid1 AS rowid2, score FROM scored WHERE score >= 0.7
QUALIFY row_number() OVER (PARTITION BY scored.rowid2 ORDER BY score DESC, scored.rowid1) = 1""")
query("split_pair", "SELECT rowid1, rowid2, score AS confidence_score FROM scored")
query("explode_clusters", "SELECT rowid2 AS rowid, rowid1 AS cluster_id, (rowid2 % 100) / 100.0 AS confidence_score FROM edges")
query("stack_clustered", "SELECT rowid, sid, dataset, date_of_birth, cluster_id FROM linked")

# -- runs of the study grid -----------------------------------------------------------

SPEC = "arm, ss_train, em_train, ss_eval, em_eval, framework, budget, sample_size, model_iter"
# The data sets of the grid's sizes: the steps of the study's data sets once more, with names of their own.
_CHAIN = ("wanted_sizes share_list size_total shifted adjusted quotas offered wide fill3 fill4 fill4b fill5 fill5b fill5c takes chosen "
          "admin_rows eligible moved datasets").split()
for _name in _CHAIN:
    step(f"{_name}_q", re.sub(rf"\b({'|'.join(_CHAIN)})\b", r"\1_q", CTES[_name]))
step("wanted_sizes_q", f"SELECT unnest({list(study.QUERY_GRID.sizes)}) AS spec_n")
step("share_list_q", "SELECT 0.5::DOUBLE AS share_exact")

step("grid_its", f"SELECT unnest(range({study.QUERY_GRID.iterations})) AS model_iter")
step("grid_sizes", f"SELECT unnest({list(study.QUERY_GRID.sizes)}) AS ss_train")
step("grid_frameworks", "SELECT unnest(['deduplication', 'record_linkage']) AS framework")


def grid_sql(rules: study.GridRules) -> str:
    # `model` names what runs share that differ in nothing
    return f"""
SELECT *, 50 AS em_train, ss_train AS ss_eval, 50 AS em_eval, ss_train || '__50' AS spec,
  arm || '/' || ss_train || '/' || framework || '/' || budget || '/' || sample_size || '/' || model_iter AS run,
  arm || '/' || ss_train || '/' || framework || '/' || budget || '/' || sample_size || '/'
    || CASE arm WHEN 'unsupervised' THEN 0 ELSE model_iter END AS model
FROM (
  SELECT 'supervised' AS arm, ss_train, '' AS framework, 0 AS budget, 0 AS sample_size, model_iter FROM grid_sizes, grid_its
  UNION ALL SELECT 'unsupervised', ss_train, framework, 0, 0, model_iter FROM grid_sizes, grid_its, grid_frameworks
  UNION ALL SELECT 'active', ss_train, framework, budget, sample_size, model_iter
  FROM grid_sizes, grid_its, grid_frameworks, (SELECT unnest({list(rules.budgets)}) AS budget),
    (SELECT unnest({list(rules.sample_sizes)}) AS sample_size)
  WHERE framework = 'deduplication' OR sample_size IN {rules.linkage_sample_sizes})"""


step("grid", grid_sql(study.QUERY_GRID))

# -- linkers: weights from label counts, in plain sums --

_G = ["g_first", "g_last", "g_dob", "g_mi", "g_race", "g_sex", "g_month", "g_day"]
_LEVEL_LIST = ", ".join(_G)


def _weight_list(yes: str, no: str) -> list[str]:
    """The prior and the weight of each field and level, from sums of two columns."""
    def share(of: str, g: str, level: int) -> str:
        return (f"(sum(CASE WHEN {g} = {level} THEN {of} ELSE 0 END) + 0.5::DOUBLE)"
                f" / (sum(CASE WHEN {g} IS NOT NULL THEN {of} ELSE 0 END) + 1.5::DOUBLE)")
    return [f"round(ln((sum({yes}) + 0.5::DOUBLE) / (sum({no}) + 0.5::DOUBLE)), 9)"] + [
        f"round(ln({share(yes, g, v)}) - ln({share(no, g, v)}), 9)" for g in _G for v in range(3)]


def _odds(w: str) -> str:
    """Log odds of the levels of a row under a list of weights."""
    parts = [f"coalesce(CASE {g} " + " ".join(f"WHEN {v} THEN {w}[{2 + 3 * i + v}]" for v in range(3)) + " END, 0.0::DOUBLE)" for i, g in enumerate(_G)]
    return f"round({w}[1] + {' + '.join(parts)}, 6)"


_KNOWN = " + ".join(f"CAST({g} IS NOT NULL AS INT)" for g in _G)
_MEAN = f"({' + '.join(f'coalesce({g}, 0)' for g in _G)}) / CAST(greatest(2 * ({_KNOWN}), 1) AS DOUBLE)"

step("ds_rows", f"""
SELECT d.spec, split_part(d.dataset, '_', 2) AS side, rowid, sid, d.dataset, {COMPARED}, year(date_of_birth) AS yob, 1 AS copies
FROM datasets_q d JOIN pool USING (rowid)""")
step("ds_joined", " UNION ".join(f"""
SELECT a.spec, a.side, {_BOTH} FROM ds_rows a JOIN ds_rows b ON a.spec = b.spec AND a.side = b.side AND a.rowid < b.rowid AND {keys}"""
    for keys in ("a.last_name = b.last_name AND a.yob = b.yob",
                 "a.first_name = b.first_name AND a.middle_initial = b.middle_initial AND a.yob = b.yob",
                 "a.date_of_birth = b.date_of_birth")))
step("ds_levels", f"""
SELECT spec, side, rowid1, rowid2, dataset1 <> dataset2 AS both_, dataset1 LIKE 'admin%' AS admin_first, CAST(sid1 = sid2 AS INT) AS label,
  coalesce(first_name1 = first_name2 AND last_name1 = last_name2 AND date_of_birth1 = date_of_birth2, false) AS exact, {_LEVELS}
FROM ds_joined""")
step("ds_pairs", f"""
SELECT *, CASE WHEN both_ THEN CASE WHEN admin_first THEN rowid2 ELSE rowid1 END END AS experiment,
  CASE WHEN both_ THEN CASE WHEN admin_first THEN rowid1 ELSE rowid2 END END AS admin,
  concat_ws('', {', '.join(f"coalesce(CAST({g} AS VARCHAR), '-')" for g in _G)}) AS pattern,
  CASE WHEN both_ THEN 'record_linkage' WHEN admin_first THEN 'deduplication' END AS pool_of
FROM ds_levels""")

# active: four rounds, always the pairs whose log odds are nearest to even
step("pool_ranked", """
SELECT p.*, framework, model_iter, row_number() OVER (PARTITION BY p.spec, framework, model_iter
    ORDER BY md5('3:pool:' || model_iter || '-' || rowid1 || '-' || rowid2), model_iter || '-' || rowid1 || '-' || rowid2) AS rank
FROM ds_pairs p JOIN (SELECT DISTINCT spec, framework, model_iter FROM grid WHERE arm = 'active') w
  ON w.spec = p.spec AND w.framework = p.pool_of WHERE side = 'training'""")
step("run_pool", f"""
SELECT model, budget, sample_size, rowid1, rowid2, label, exact, {_LEVEL_LIST}, abs(round({_MEAN}, 9) - 0.5) AS doubt
FROM pool_ranked p JOIN grid g USING (spec, framework, model_iter) WHERE arm = 'active' AND rank <= sample_size""")
_ASKED = f"model, rowid1, rowid2, label, exact, {_LEVEL_LIST}"
step("asked1", f"""
SELECT {_ASKED}, 1 AS turn, CAST(NULL AS DOUBLE) AS unsure FROM run_pool
QUALIFY row_number() OVER (PARTITION BY model ORDER BY doubt, rowid1, rowid2) <= ceil(budget / 4)""")
for _turn in range(1, 5):
    step(f"learned{_turn}", f"SELECT model, [{', '.join(_weight_list('label', '(1 - label)'))}] AS w FROM asked{_turn} GROUP BY model")
    if _turn < 4:
        step(f"asked{_turn + 1}", f"""
SELECT {_ASKED}, turn, unsure FROM asked{_turn}
UNION ALL (SELECT {_ASKED}, {_turn + 1}, unsure FROM (
  SELECT p.*, abs({_odds('w')}) AS unsure FROM run_pool p JOIN learned{_turn} USING (model)
  WHERE NOT EXISTS (SELECT 1 FROM asked{_turn} a WHERE a.model = p.model AND a.rowid1 = p.rowid1 AND a.rowid2 = p.rowid2))
  QUALIFY row_number() OVER (PARTITION BY model ORDER BY unsure, rowid1, rowid2) <= ceil(budget / 4))""")

# supervised: nine tenths of the labelled training pairs, the cut from the others
step("train_rows", """
SELECT p.*, model, ('0x' || substr(md5('3:train:' || model_iter || ':' || rowid1 || ':' || rowid2), 1, 15))::BIGINT % 1000 < 900 AS used
FROM ds_pairs p JOIN grid g USING (spec) WHERE arm = 'supervised' AND side = 'training'""")
step("supervised_w", f"SELECT model, [{', '.join(_weight_list('label', '(1 - label)'))}] AS w FROM train_rows WHERE used GROUP BY model")
step("held_bins", f"""
SELECT model, CAST(floor({_odds('w')} * 10) AS INT) AS bin, sum(label) AS hits, count(*) AS n
FROM train_rows JOIN supervised_w USING (model) WHERE NOT used GROUP BY model, bin""")
step("held_curve", """
SELECT model, bin, sum(hits) OVER above AS h, sum(n) OVER above AS k, sum(hits) OVER (PARTITION BY model) AS every
FROM held_bins WINDOW above AS (PARTITION BY model ORDER BY bin DESC)""")
step("held_best", """
SELECT model, bin / 10.0::DOUBLE AS cut FROM held_curve
QUALIFY row_number() OVER (PARTITION BY model ORDER BY 2 * h / CAST(k + every AS DOUBLE) DESC, bin) = 1""")

# unsupervised: forty steps of expectation and maximisation over pattern counts
step("em_counts", f"""
SELECT model, {_LEVEL_LIST}, count(*) AS n FROM ds_pairs p JOIN grid g USING (spec)
WHERE arm = 'unsupervised' AND model_iter = 0 AND side = 'evaluation' AND (both_ OR framework = 'deduplication') GROUP BY ALL""")
step("em_run", f"""
SELECT model, 1 AS turn, [{', '.join(_weight_list('y', 'z'))}] AS w
FROM (SELECT *, n * ({_MEAN}) AS y, n * (1 - {_MEAN}) AS z FROM em_counts) GROUP BY model
UNION ALL
SELECT model, turn + 1, [{', '.join(_weight_list('y', 'z'))}] FROM (
  SELECT c.*, turn, n / (1 + exp(-{_odds('w')})) AS y, n * (1 - 1 / (1 + exp(-{_odds('w')}))) AS z
  FROM em_run e JOIN em_counts c USING (model) WHERE turn < 40)
GROUP BY model, turn""")

step("model_w", """
SELECT model, w, 0.0::DOUBLE AS cut FROM learned4
UNION ALL SELECT model, w, coalesce(cut, 0.0::DOUBLE) FROM supervised_w LEFT JOIN held_best USING (model)
UNION ALL SELECT model, w, round(ln(0.85 / (1 - 0.85)), 6) FROM em_run WHERE turn = 40""")
step("model_odds", f"""
SELECT model, arm, framework, cut, spec, pattern, {_odds('w')} AS odds
FROM (SELECT DISTINCT spec, pattern, {_LEVEL_LIST} FROM ds_pairs WHERE side = 'evaluation')
JOIN (SELECT DISTINCT model, arm, framework, spec FROM grid) USING (spec) JOIN model_w USING (model)""")
step("model_pairs", """
SELECT model, arm, framework, cut, odds, rowid1, rowid2, experiment, admin, both_
FROM ds_pairs JOIN model_odds USING (spec, pattern)
WHERE side = 'evaluation' AND (both_ OR framework = 'deduplication') AND (odds >= cut OR framework = 'deduplication')""")
step("model_best", """
SELECT model, admin, experiment FROM model_pairs WHERE arm <> 'unsupervised' AND framework <> 'deduplication' AND odds >= cut
QUALIFY row_number() OVER (PARTITION BY model, admin ORDER BY odds DESC, experiment) = 1""")
step("model_ways", """
SELECT model, rowid1 AS a, rowid2 AS b FROM model_pairs WHERE arm = 'unsupervised' AND odds >= cut
UNION ALL SELECT model, rowid2, rowid1 FROM model_pairs WHERE arm = 'unsupervised' AND odds >= cut""")
step("model_reached", """
SELECT DISTINCT model, a AS rowid, a AS root FROM model_ways
UNION SELECT r.model, w.b, r.root FROM model_reached r JOIN model_ways w ON w.model = r.model AND w.a = r.rowid WHERE r.root < w.b""")
average_linkage_steps("mean", """
SELECT model, rowid1 AS a, rowid2 AS b, round(1000000 / (1 + exp(-odds))) AS total FROM model_pairs
WHERE arm = 'active' AND framework = 'deduplication' AND round(1000000 / (1 + exp(-odds))) > 0""", 500000)
step("model_clusters", """
SELECT model, admin AS rowid, experiment AS cluster_id FROM model_best
UNION ALL SELECT DISTINCT model, experiment, experiment FROM model_best
UNION ALL SELECT model, rowid, min(root) FROM model_reached GROUP BY model, rowid
UNION ALL SELECT model, rowid, cluster_id FROM mean_last""")
step("run_rows", """
SELECT g.run, d.rowid, d.sid, d.dataset,
  coalesce(c.cluster_id, CASE WHEN d.dataset = 'admin_evaluation' THEN -2 ELSE -1 END) AS cluster_id
FROM grid g JOIN ds_rows d ON d.spec = g.spec AND d.side = 'evaluation'
LEFT JOIN model_clusters c ON c.model = g.model AND c.rowid = d.rowid""")
step("run_exp", "SELECT * FROM run_rows WHERE dataset = 'experiment_evaluation'")
step("run_adm", "SELECT * FROM run_rows WHERE dataset = 'admin_evaluation'")
metric_steps("run_", "run_exp", "run_adm", "run")
query("eval_summary", f"SELECT {SPEC}, {rounded(METRICS)} FROM run_summary JOIN grid USING (run)")
step("run_sampled", """
SELECT model, CAST(sum(label) AS BIGINT) AS cp_1s, count(*) FILTER (label = 1 AND NOT exact) AS cp_1s__nem, count(*) / max(sample_size) AS realized_blocked_proportion
FROM run_pool GROUP BY model""")
query("label_rounds", """
SELECT spec, framework, model_iter, budget, sample_size, turn AS round, count(*) AS n_labels, CAST(sum(label) AS BIGINT) AS n_matches,
  CAST(sum(CAST(exact AS INT)) AS BIGINT) AS n_exact, round(min(unsure), 6) AS least_doubt, round(max(unsure), 6) AS most_doubt,
  min(rowid1) AS first_rowid, max(rowid2) AS last_rowid
FROM asked4 JOIN (SELECT DISTINCT model, spec, framework, model_iter, budget, sample_size FROM grid) USING (model) GROUP BY ALL""")
query("run_models", "SELECT arm, spec, framework, budget, sample_size, model_iter, round(cut, 6) AS cut, round(w[1], 6) AS w, " + ", ".join(
    f"round(w[{2 + 3 * i + v}], 6) AS w_{g}_{v}" for i, g in enumerate(_G) for v in range(3)) + """
FROM model_w JOIN grid USING (model) WHERE arm <> 'unsupervised' OR model_iter = 0""")
query("run_ledger", """
SELECT stage, 'exact keys' AS spec, stage = 'cluster' AS failed, true AS timed, stage = 'cluster' AS explained
FROM (SELECT unnest(['block', 'link', 'evaluate', 'cluster']) AS stage)""")
step("run_log", """
SELECT run, labeled_1s, labeled_0s, labeled_1s / (labeled_1s + labeled_0s) AS labeled_base_rate, cp_1s, cp_1s__nem, realized_blocked_proportion,
  CASE arm WHEN 'active' THEN 4 WHEN 'supervised' THEN 2 ELSE 3 END AS n_runtimes
FROM grid LEFT JOIN run_sampled USING (model)
LEFT JOIN (SELECT model, CAST(sum(label) AS BIGINT) AS labeled_1s, CAST(sum(1 - label) AS BIGINT) AS labeled_0s FROM asked4 GROUP BY model) USING (model)""")
step("results", f"""
SELECT {SPEC}, run, CASE WHEN framework = '' THEN arm ELSE arm || ' (' || framework || ')' END AS algorithm,
  {rounded(METRICS)}, l.* EXCLUDE (run)
FROM run_summary JOIN grid USING (run) JOIN run_log l USING (run)""")
query("eval_summary_ext", f"""
SELECT {SPEC}, {', '.join(ANY)}, cp_1s, cp_1s__nem, labeled_1s, labeled_0s, n_runtimes,
  {rounded(['labeled_base_rate', 'realized_blocked_proportion'], 6)} FROM results""")
step("places", """
SELECT spec, rowid, row_number() OVER (PARTITION BY spec ORDER BY sid, rowid) - 1 AS place, count(*) OVER (PARTITION BY spec) AS n
FROM ds_rows WHERE dataset = 'experiment_evaluation'""")


def bootstrap_steps(prefix: str, where: str) -> None:
    step(f"{prefix}_draws", f"""
SELECT spec, bs_iter, ('0x' || substr(md5((333 + bs_iter) || ':' || slot), 1, 15))::BIGINT % n AS place
FROM (SELECT unnest(range({study.RESAMPLES})) AS bs_iter), (SELECT spec, n, unnest(range(n)) AS slot FROM (SELECT DISTINCT spec, n FROM places))""")
    step(f"{prefix}_flags", f"""
SELECT f.run, p.spec, p.place, expected, made FROM run_flags f JOIN grid g USING (run) JOIN places p ON p.spec = g.spec AND p.rowid = f.rowid WHERE {where}""")
    # records with the same outcome in every run are drawn as one
    step(f"{prefix}_alike", f"""
SELECT spec, place, string_agg(CAST(expected AS INT) || CAST(made AS INT), '' ORDER BY run) AS alike FROM {prefix}_flags GROUP BY spec, place""")
    step(f"{prefix}_outcomes", f"SELECT DISTINCT spec, alike, run, expected, made FROM {prefix}_flags JOIN {prefix}_alike USING (spec, place)")
    step(f"{prefix}_drawn", f"SELECT spec, bs_iter, alike, count(*) AS n FROM {prefix}_draws JOIN {prefix}_alike USING (spec, place) GROUP BY ALL")
    step(f"{prefix}_metrics", f"""
SELECT run, bs_iter, coalesce(sum(n) FILTER (expected AND made), 0) / sum(n) FILTER (expected) AS tpr_any,
  coalesce(sum(n) FILTER (expected AND made), 0) / sum(n) FILTER (made) AS prc_any,
  coalesce(sum(n) FILTER (NOT expected AND NOT made), 0) / sum(n) FILTER (NOT expected) AS tnr_any
FROM {prefix}_drawn JOIN {prefix}_outcomes USING (spec, alike) GROUP BY run, bs_iter""")
    step(prefix, f"""
SELECT {SPEC}, run, bs_iter, CASE WHEN framework = '' THEN arm ELSE arm || ' (' || framework || ')' END AS algorithm,
  {rounded(['tpr_any', 'prc_any', 'tnr_any'])}, round((1 - tnr_any) + (1 - tpr_any), 9) AS error_any
FROM {prefix}_metrics JOIN grid USING (run)""")


bootstrap_steps("boot_full", "arm = 'supervised'")
query("bootstrap_eval", f"SELECT {SPEC}, bs_iter, {', '.join(ANY)} FROM boot_full")
bootstrap_steps("boot", "true")
query("bootstrap_eval_all_arms", f"SELECT {SPEC}, bs_iter, {', '.join(ANY)} FROM boot")

# -- results and reports --------------------------------------------------------------

EVAL = SPEC.removeprefix("arm, ")
query("hms_minutes", """
SELECT event_id, round((hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) / 60, 9) AS runtime FROM events""")
query("runtime_columns", """
SELECT user_id, round((sum(minute(ts)) * 60 + sum(floor(second(ts)))) / 60, 9) AS runtime_min,
       round((count(*) * 3600 + sum(minute(ts)) * 60) / 60, 9) AS runtime_scoring_min FROM events GROUP BY user_id""")
query("spec_from_path", """
SELECT arm, tpr_any, prc_any, ss_train, em_train, budget, sample_size, nullif(framework, '') AS framework, model_iter FROM results""")
query("write_results", f"""
SELECT r.algorithm, {', '.join('r.' + c for c in EVAL.split(', '))}, r.error_any, count(*) AS n_resamples, min(b.error_any) AS lowest
FROM results r JOIN boot b USING (run) GROUP BY ALL""")
query("collect_results", f"SELECT algorithm, {EVAL}, {', '.join(METRICS)}, labeled_1s FROM results")
query("f1_scores", f"""
SELECT algorithm, {EVAL}, round(2 * prc_any * tpr_any / nullif(prc_any + tpr_any, 0), 9) AS f1_any,
       round(2 * prc_corr * tpr_corr / nullif(prc_corr + tpr_corr, 0), 9) AS f1_corr FROM results""")
query("total_runtime", f"SELECT algorithm, {EVAL}, n_runtimes > 0 AS measured FROM results")
query("first_runs", f"SELECT algorithm, {EVAL}, bs_iter, error_any FROM boot WHERE model_iter < {study.RUNS_KEPT}")
step("kept", f"SELECT * FROM results WHERE model_iter < {study.RUNS_KEPT}")
query("report_input", f"SELECT 'study' AS task, ss_train AS n_admin_rows, algorithm, {EVAL}, error_any FROM kept")
_ARMS = """ WHERE sample_size IN (0, 150000) OR (algorithm = 'active (deduplication)' AND sample_size = 1500)
  OR (algorithm = 'active (record_linkage)' AND sample_size = 15000)"""
_INTERVENTION = """arm || CASE WHEN sample_size = 150000 THEN ' (optimized)' WHEN sample_size = 0 THEN ''
  ELSE ' (default)' END AS intervention"""
step("labelled_runs", f"SELECT *, {_INTERVENTION} FROM kept {_ARMS}")
query("arm_labels", f"SELECT intervention, {EVAL} FROM labelled_runs")


def _flag(group: str, order: str) -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY {order}, model_iter) = 1"


step("figure_medians", "SELECT *, median(error_any) OVER (PARTITION BY algorithm, ss_train, budget, sample_size) AS mid FROM kept")
step("figure_runs", f"""
SELECT * EXCLUDE (mid), {_flag('algorithm, ss_train, budget, sample_size', 'abs(error_any - mid)')} AS is_median FROM figure_medians""")
query("median_run", f"SELECT algorithm, {EVAL}, error_any, is_median FROM figure_runs")
_G = "intervention, ss_train, framework, budget"
step("point_medians", f"SELECT *, median(error_any) OVER (PARTITION BY {_G}) AS mid FROM labelled_runs")
step("points", f"""
SELECT *, {_flag(_G, 'abs(error_any - mid)')} AS is_median, {_flag(_G, 'error_any')} AS is_best,
  {_flag(_G, 'error_any DESC')} AS is_worst FROM point_medians""")
query("best_worst_run", f"SELECT intervention, {EVAL}, is_best, is_worst FROM points")
step("flags", """
SELECT *, (is_worst AND intervention = 'active (optimized)') OR (is_best AND intervention <> 'active (optimized)')
  AS is_worst_case_scenario FROM points""")
query("worst_case_flag", f"SELECT intervention, {EVAL}, is_median, is_worst_case_scenario FROM flags")
step("flagged", """
SELECT b.*, f.intervention, f.is_median, f.is_worst_case_scenario FROM boot b JOIN flags f USING (run)""")
query("bootstrap_flags", f"""
SELECT intervention, {EVAL}, bs_iter, error_any, is_median, is_worst_case_scenario FROM flagged""")


def _versus(name: str, intervention: str, keys: list[str], difference: str) -> str:
    match = " AND ".join(f"o.{k} = c.{k}" for k in [*keys, "bs_iter"])
    return f"""
SELECT o.framework, o.ss_train, o.budget, '{name}' AS comparison_alg, o.model_iter AS model_iter__optimized,
  c.model_iter AS model_iter__comparison, o.bs_iter, o.error_any AS error_any__optimized, c.error_any AS error_any__comparison,
  {difference} AS performance_difference,
  coalesce(o.is_median AND c.is_median, false) AS median_comparison,
  coalesce(o.is_worst_case_scenario AND c.is_worst_case_scenario, false) AS worst_case_scenario_comparison,
  true AS crossproduct_comparison
FROM (SELECT * FROM flagged WHERE intervention = 'active (optimized)') o
LEFT JOIN (SELECT * FROM flagged WHERE intervention = '{intervention}') c ON {match}"""


step("compared", " UNION ALL ".join((
    _versus("default_active", "active (default)", ["ss_train", "framework", "budget"], "c.error_any - o.error_any"),
    _versus("unsupervised", "unsupervised", ["ss_train", "framework"], "c.error_any - o.error_any"),
    _versus("supervised", "supervised", ["ss_train"], "o.error_any - c.error_any"))))
_CK = "framework, ss_train, budget, comparison_alg, model_iter__optimized, model_iter__comparison"
# the comparison goes over the whole grid: the steps from the grid on once more, with names of their own
_WHOLE = {"grid_its": f"SELECT unnest(range({study.COMPARED_GRID.iterations})) AS model_iter", "grid": grid_sql(study.COMPARED_GRID)}
for _name in [*CTES]:
    if _name in _WHOLE or set(re.findall(r"\w+", CTES[_name])) & _WHOLE.keys():
        _WHOLE.setdefault(_name, CTES[_name])
for _name, _sql in _WHOLE.items():
    step(f"{_name}_w", re.sub(rf"\b({'|'.join(_WHOLE)})\b", r"\1_w", _sql))
query("arm_comparison", f"SELECT {_CK}, bs_iter, error_any__optimized, error_any__comparison FROM compared_w")
query("performance_difference", f"SELECT {_CK}, bs_iter, {rounded(['performance_difference'])} FROM compared")
query("comparison_kinds", f"""
SELECT {_CK}, bs_iter, median_comparison, worst_case_scenario_comparison, crossproduct_comparison FROM compared""")
step("tests", f"""
SELECT {_CK}, quantile_cont(performance_difference, 0.05) AS performance_difference_at_pctl,
  bool_or(median_comparison) AS median_comparison, bool_or(worst_case_scenario_comparison) AS worst_case_scenario_comparison,
  bool_or(crossproduct_comparison) AS crossproduct_comparison,
  quantile_cont(performance_difference, 0.05) > 0 AS significantly_better
FROM compared WHERE model_iter__comparison IS NOT NULL GROUP BY {_CK}""")
query("significance_test", "SELECT * REPLACE (round(performance_difference_at_pctl, 6) AS performance_difference_at_pctl) FROM tests")
step("shares", """
SELECT framework, ss_train, budget, comparison_alg, avg(CAST(significantly_better AS INT)) AS significantly_better
FROM tests GROUP BY ALL""")
query("share_significant", "SELECT * REPLACE (round(significantly_better, 9) AS significantly_better) FROM shares")
step("cells", """
SELECT framework, comparison_alg, comparison, ss_train || '_' || budget AS col, avg(v) AS v FROM (
  SELECT framework, comparison_alg, ss_train, budget, CAST(significantly_better AS INT) AS v, 'Median comparison' AS comparison
  FROM tests WHERE median_comparison
  UNION ALL SELECT framework, comparison_alg, ss_train, budget, CAST(significantly_better AS INT), 'Worst-case comparison'
  FROM tests WHERE worst_case_scenario_comparison
  UNION ALL SELECT framework, comparison_alg, ss_train, budget, significantly_better, 'Share of all possible comparisons' FROM shares)
GROUP BY ALL""")
step("texts", """
SELECT *, CASE WHEN bool_or(v > 0 AND v < 1) OVER (PARTITION BY framework, comparison)
  THEN CAST(CAST(round_even(v * 100, 0) AS INT) AS VARCHAR) || '%' WHEN v = 1 THEN '*' ELSE '' END AS cell FROM cells""")
step("report", """
SELECT framework,
  CASE comparison_alg WHEN 'default_active' THEN 'Is the optimised active arm better than the default active arm?'
    WHEN 'unsupervised' THEN 'Is the optimised active arm better than the unsupervised arm?'
    ELSE 'Is the supervised arm better than the optimised active arm?' END AS question, comparison,
  """ + ", ".join(f"max(cell) FILTER (col = '{s}_{b}') AS \"{s}_{b}\"" for s in study.QUERY_GRID.sizes for b in study.QUERY_GRID.budgets) + """,
  CASE comparison_alg WHEN 'default_active' THEN 1 WHEN 'unsupervised' THEN 2 ELSE 3 END AS question_order,
  CASE comparison WHEN 'Median comparison' THEN 1 WHEN 'Worst-case comparison' THEN 2 ELSE 3 END AS comparison_order
FROM texts GROUP BY framework, comparison_alg, comparison""")
query("significance_report", "SELECT * FROM report")
query("report_sink", "SELECT * FROM report")
step("boot_f1", "SELECT *, 2 * prc_any * tpr_any / nullif(prc_any + tpr_any, 0) AS f1_any FROM boot")
_CI = ["tpr_any", "prc_any", "tnr_any", "error_any", "f1_any"]
step("intervals", "SELECT run, " + ", ".join(
    f"round(quantile_cont({m}, {q}), 6) AS {m}__{side}_bound" for m in _CI
    for side, q in (("lower", 0.025), ("upper", 0.975))) + " FROM boot_f1 GROUP BY run")
query("confidence_intervals", f"""
SELECT algorithm, {EVAL}, i.* EXCLUDE (run) FROM kept r LEFT JOIN intervals i USING (run)""")
query("figure_points", """
SELECT ss_train, budget, model_iter, CASE budget WHEN 20 THEN 1 ELSE 6 END AS budget_map,
  labeled_1s >= 10 AND labeled_0s >= 10 AS meets_label_requirements,
  framework || CASE WHEN labeled_1s >= 10 AND labeled_0s >= 10 THEN ' True' ELSE ' False' END
    AS framework__meets_label_requirements, error_pair, prc_corr, tpr_corr, defaults
FROM kept, (VALUES (true), (false)) AS shown(defaults)
WHERE arm = 'active' AND CASE WHEN defaults THEN sample_size = CASE framework WHEN 'deduplication' THEN 1500 ELSE 15000 END
  ELSE sample_size = 150000 END""")
step("benchmarks", """
SELECT f.*, i.error_any__lower_bound, i.error_any__upper_bound FROM figure_runs f JOIN intervals i USING (run)
WHERE algorithm IN ('supervised', 'unsupervised (record_linkage)')""")
_LINE = "algorithm, ss_train, model_iter, round(error_any, 6) AS error_any, error_any__lower_bound, error_any__upper_bound"
query("benchmark_lines", f"""
SELECT algorithm, ss_train, CAST(NULL AS INT) AS model_iter, round(avg(error_any), 6) AS error_any,
  CAST(NULL AS DOUBLE) AS error_any__lower_bound, CAST(NULL AS DOUBLE) AS error_any__upper_bound, 'mean' AS lines
FROM benchmarks GROUP BY algorithm, ss_train
UNION ALL SELECT {_LINE}, 'median' FROM benchmarks WHERE is_median
UNION ALL SELECT {_LINE}, 'first' FROM benchmarks WHERE model_iter = 0
UNION ALL SELECT {_LINE}, 'all' FROM benchmarks""")
query("sample_size_means", """
SELECT budget, ss_train, 'Sample size: ' || format('{:,}', sample_size) AS specification,
  round(avg(error_any), 6) AS error_any, round(avg(prc_any), 6) AS prc_any, round(avg(tpr_any), 6) AS tpr_any,
  CASE budget WHEN 20 THEN 1 ELSE 6 END AS budget_map
FROM kept WHERE arm = 'active' GROUP BY budget, ss_train, sample_size""")
query("stage_outputs", """
SELECT stage, rowid, count(*) AS n FROM (
  SELECT 'blocks' AS stage, rowid FROM members UNION ALL SELECT 'predicted_matches', rowid1 FROM edges
  UNION ALL SELECT 'predicted_clusters', rowid FROM components) GROUP BY ALL""")
