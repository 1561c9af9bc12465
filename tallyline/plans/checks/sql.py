"""SQL building blocks shared by the statements of several queries."""

CONTRACT = """
contract AS (
  SELECT p_brand || '.' || p_type AS code,
         min(p_name) || ' ' || lower(p_type) AS description,
         CASE min(p_partkey) % 4 WHEN 1 THEN 'EA' WHEN 2 THEN 'LS' ELSE 'FT' END AS uom,
         min(p_retailprice) AS unit_price,
         CAST(sum(p_size) * 10 AS DOUBLE) AS est_qty,
         min(p_partkey) AS item_no
  FROM part GROUP BY p_brand, p_type)"""

LINES = """
lines AS (
  SELECT r_name AS project_id, n_name AS contractor_id,
         CAST(year(l_shipdate) - 1994 AS INTEGER) AS cycle_no,
         CASE WHEN l_partkey % 50 <> 0 THEN p_brand || '.' || p_type END AS code,
         coalesce(CASE WHEN l_partkey % 50 <> 0 THEN p_brand || '.' || p_type END, '~' || lower(trim(p_name))) AS uk,
         p_name AS raw_desc, n_nationkey, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
         l_quantity AS qty, l_extendedprice AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
       JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CYCLES = """
cycles AS (
  SELECT project_id, contractor_id, cycle_no, 'FY' || CAST(cycle_no + 1994 AS VARCHAR) AS period_label,
         CASE WHEN min(n_nationkey) % 2 = 0 THEN 'cumulative' ELSE 'discrete' END AS billing_mode,
         CAST(5.0 + (min(n_nationkey) % 3) * 2.5 AS DOUBLE) AS retainage_pct
  FROM lines GROUP BY ALL)"""

_UNITS = """
built AS (
  SELECT project_id, contractor_id, cycle_no, uk, max(code) AS code, min(raw_desc) AS raw_desc,
         CAST(sum(CAST(qty AS DECIMAL(18,4))) AS DOUBLE) AS built_qty
  FROM lines WHERE l_returnflag <> 'R' GROUP BY ALL),
billed AS (
  SELECT project_id, contractor_id, cycle_no, uk, max(code) AS code, min(raw_desc) AS raw_desc,
         CAST(sum(CAST(qty AS DECIMAL(18,4))) AS DOUBLE) AS sum_qty,
         CAST(sum(CAST(amount AS DECIMAL(18,4))) AS DOUBLE) AS sum_amount,
         max(CASE WHEN rn = 1 THEN qty END) AS top_qty,
         max(CASE WHEN rn = 1 THEN amount END) AS top_amount
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, contractor_id, cycle_no, uk
          ORDER BY qty DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, amount) AS rn FROM lines)
  GROUP BY project_id, contractor_id, cycle_no, uk),
units AS (
  SELECT project_id, contractor_id, cycle_no, uk, coalesce(a.code, b.code) AS code,
         coalesce(a.raw_desc, b.raw_desc) AS raw_desc,
         coalesce(built_qty, 0) AS built_qty, sum_qty, sum_amount, top_qty, top_amount
  FROM built a FULL JOIN billed b USING (project_id, contractor_id, cycle_no, uk)),
moded AS (
  SELECT u.*, {mode} AS billing_mode FROM units u {mode_join}),
figured AS (
  SELECT *, coalesce(CASE WHEN billing_mode = 'cumulative' THEN top_qty ELSE sum_qty END, 0) AS billed_qty,
         coalesce(CASE WHEN billing_mode = 'cumulative' THEN top_amount / top_qty ELSE sum_amount / sum_qty END, 0) AS billed_price
  FROM moded)"""

_PRIOR = """,
numbered AS (
  SELECT project_id, contractor_id, cycle_no,
         lag(cycle_no) OVER (PARTITION BY project_id, contractor_id ORDER BY cycle_no) AS prior_no
  FROM (SELECT DISTINCT project_id, contractor_id, cycle_no FROM lines)),
priced AS (
  SELECT f.*, CASE WHEN f.billing_mode = 'cumulative' THEN p.billed_qty END AS prior_billed_qty
  FROM figured f JOIN numbered n USING (project_id, contractor_id, cycle_no)
  LEFT JOIN figured p ON p.project_id = f.project_id AND p.contractor_id = f.contractor_id
       AND p.cycle_no = n.prior_no AND p.code = f.code)"""

_NO_PRIOR = """,
priced AS (SELECT *, CAST(NULL AS DOUBLE) AS prior_billed_qty FROM figured)"""

_FLAGS = """,
matched AS (
  SELECT p.project_id, p.contractor_id, p.cycle_no, p.code, coalesce(c.description, p.raw_desc) AS description,
         coalesce(c.uom, 'EA') AS uom, p.built_qty, p.billed_qty, c.unit_price AS contract_price, p.billed_price,
         c.est_qty, p.billing_mode, p.prior_billed_qty,
         p.billed_qty * p.billed_price AS billed_amount,
         coalesce(p.built_qty * c.unit_price, 0) AS expected_amount,
         p.billed_qty * p.billed_price - coalesce(p.built_qty * c.unit_price, 0) AS variance,
         CASE WHEN coalesce(c.uom, 'EA') = 'FT' THEN greatest(50.0, abs(p.built_qty) * 0.02) ELSE 0 END AS band
  FROM priced p LEFT JOIN {contract} c ON p.code = c.code),
ruled AS (
  SELECT *, concat_ws(',',
      CASE WHEN contract_price IS NULL AND (billed_qty > 0 OR billed_amount <> 0) THEN 'no_contract' END,
      CASE WHEN billed_qty - built_qty > band THEN 'qty_over' END,
      CASE WHEN billed_price > contract_price + 1e-6 THEN 'price_over' END,
      CASE WHEN est_qty <> 0 AND greatest(built_qty, billed_qty) > est_qty THEN 'over_run' END,
      CASE WHEN code IS NULL AND (billed_qty > 0 OR billed_amount <> 0) THEN 'unmatched' END,
      CASE WHEN billing_mode = 'cumulative' AND prior_billed_qty - billed_qty > band THEN 'cumulative_decrease' END,
      CASE WHEN built_qty - billed_qty > band THEN 'under_billed' END,
      CASE WHEN billed_price < contract_price - 1e-6 AND (billed_qty > 0 OR billed_amount <> 0) THEN 'price_under' END
    ) AS rules FROM matched),
recon AS (
  SELECT *, coalesce(nullif(code, ''), description) AS row_key,
    CASE WHEN regexp_matches(rules, 'no_contract|qty_over|price_over') THEN 'critical'
         WHEN regexp_matches(rules, 'over_run|unmatched|cumulative_decrease') THEN 'warning'
         WHEN rules <> '' THEN 'info' ELSE 'ok' END AS severity
  FROM ruled)"""


def recon(mode: str = "cumulative", prior: bool = False, contract: str = "contract", extra: str = "") -> str:
    """CTEs up to ``recon``; mode is a billing mode or 'mixed' (per cycle)."""
    units = (
        _UNITS.format(mode="y.billing_mode", mode_join="JOIN cycles y USING (project_id, contractor_id, cycle_no)")
        if mode == "mixed"
        else _UNITS.format(mode=f"'{mode}'", mode_join="")
    )
    return "WITH" + ",".join([CONTRACT, *([extra] if extra else []), LINES, CYCLES, units]) + (_PRIOR if prior else _NO_PRIOR) + _FLAGS.format(contract=contract)


ROW = """project_id, contractor_id, cycle_no, code, description, uom, built_qty, billed_qty, contract_price,
  round(billed_price, 8) AS billed_price, est_qty, round(billed_amount, 2) AS billed_amount,
  round(expected_amount, 2) AS expected_amount, round(variance, 2) AS variance, severity, rules"""


def normalize(x: str) -> str:
    """SQL of the crosswalk key for plain ASCII text."""
    cleaned = f"lower(trim({x}))"
    cleaned = f"regexp_replace({cleaned}, '[\"'']', ' in ', 'g')"
    cleaned = f"regexp_replace({cleaned}, '\\b(\\d{{2,4}})\\s*(?:f|ct|cnt|count|fiber|fibers|c)\\b', '\\1count', 'g')"
    cleaned = f"trim(regexp_replace(regexp_replace({cleaned}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    words = (
        "CASE w WHEN 'ct' THEN 'count' WHEN 'cnt' THEN 'count' WHEN 'ug' THEN 'underground' WHEN 'mr' THEN 'makeready' "
        "WHEN 'lf' THEN 'ft' WHEN 'ln' THEN 'ft' WHEN 'each' THEN 'ea' WHEN 'dir' THEN 'directional' "
        "WHEN 'hh' THEN 'handhole' WHEN 'ped' THEN 'pedestal' ELSE w END"
    )
    return f"array_to_string([{words} FOR w IN string_split({cleaned}, ' ')], ' ')"


DESCRIBED = """
described AS (
  SELECT p_partkey, p_name, p_brand || '.' || p_type AS part_code,
    CASE p_partkey % 6 WHEN 0 THEN upper(p_name) || '  ' || p_type
      WHEN 1 THEN lower(regexp_replace(p_brand || '.' || p_type, '[#.]', ' - ', 'g'))
      WHEN 2 THEN p_name || ' ' || lower(p_type) || ' 12"'
      WHEN 3 THEN 'Dir. ' || p_name || ' ' || CAST(p_size % 4 * 12 + 12 AS VARCHAR) || ' ct'
      WHEN 4 THEN upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || ' / ' || p_name || ' hh'
      ELSE p_name END AS raw_desc
  FROM part)"""

RESOLVED = f"""
texts AS (SELECT DISTINCT raw_desc, {normalize('raw_desc')} AS text_key FROM described),
items AS (SELECT *, {normalize('code')} AS norm_code, {normalize('description')} AS norm_desc FROM contract),
aliases AS (SELECT p_name AS normalized_desc, min(p_brand || '.' || p_type) AS code FROM part GROUP BY 1),
code_hits AS (SELECT norm_code, arg_min(code, item_no) AS code FROM items GROUP BY 1),
scored AS (
  SELECT text_key, item_no, code, greatest(sc, sd) AS score, CASE WHEN sc >= sd THEN 'code' ELSE 'description' END AS field,
    row_number() OVER (PARTITION BY text_key ORDER BY greatest(sc, sd) DESC, item_no) AS rank
  FROM (SELECT t.text_key, i.item_no, i.code,
      100.0 * (1.0 - levenshtein(t.text_key, norm_code) / CAST(greatest(length(t.text_key), length(norm_code)) AS DOUBLE)) AS sc,
      100.0 * (1.0 - levenshtein(t.text_key, norm_desc) / CAST(greatest(length(t.text_key), length(norm_desc)) AS DOUBLE)) AS sd
    FROM (SELECT DISTINCT text_key FROM texts WHERE text_key NOT IN (SELECT normalized_desc FROM aliases)
            AND text_key NOT IN (SELECT norm_code FROM code_hits)) t, items i)),
resolved AS (
  SELECT t.raw_desc, t.text_key,
    coalesce(a.code, h.code, CASE WHEN s.score >= 70 THEN s.code END) AS code,
    CASE WHEN a.code IS NOT NULL OR h.code IS NOT NULL THEN 100.0 ELSE s.score END AS score,
    CASE WHEN a.code IS NOT NULL THEN 'alias' WHEN h.code IS NOT NULL THEN 'code' WHEN s.score >= 70 THEN 'auto' ELSE 'review' END AS kind,
    CASE WHEN a.code IS NULL AND h.code IS NOT NULL THEN h.code WHEN a.code IS NULL AND s.score >= 55 THEN s.code END AS suggested_code
  FROM texts t LEFT JOIN aliases a ON t.text_key = a.normalized_desc LEFT JOIN code_hits h ON t.text_key = h.norm_code
  LEFT JOIN scored s ON s.text_key = t.text_key AND s.rank = 1)"""

DECIDED = """
events_log AS (
  SELECT raw_desc, p_partkey AS seq, CASE p_partkey % 3 WHEN 0 THEN 'map' WHEN 1 THEN 'nic' ELSE 'reopen' END AS event,
    CASE WHEN p_partkey % 3 = 0 THEN part_code END AS code
  FROM described),
decisions AS (
  SELECT raw_desc, CASE WHEN event = 'map' THEN code END AS mapped_code, event = 'nic' AS not_in_contract
  FROM (SELECT *, row_number() OVER (PARTITION BY raw_desc ORDER BY seq DESC) AS rn FROM events_log) WHERE rn = 1 AND event <> 'reopen'),
triaged AS (
  SELECT r.raw_desc, r.score, r.suggested_code,
    CASE WHEN coalesce(not_in_contract, FALSE) THEN 'not in contract' WHEN mapped_code IS NOT NULL THEN 'confirmed'
         WHEN r.code IS NOT NULL THEN r.kind ELSE 'review' END AS bucket,
    CASE WHEN NOT coalesce(not_in_contract, FALSE) THEN coalesce(mapped_code, r.code) END AS final_code
  FROM resolved r LEFT JOIN decisions d USING (raw_desc))"""
