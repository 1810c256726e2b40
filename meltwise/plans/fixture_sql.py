"""The fixture views as SQL text, written independently of the DataFrame versions."""

from __future__ import annotations

from meltwise import constants as K


def _num(value) -> str:
    return "NULL::DOUBLE" if value is None else f"{float(value)!r}::DOUBLE"


def _element_values() -> str:
    rows = []
    for idx, el in [(0, "Ni"), *enumerate(K.FIXTURE_COMPONENTS, start=1)]:
        cols = [K.ATOMIC_WEIGHT.get(el), K.MD.get(el), K.DENSITY.get(el), K.MODULUS.get(el),
                K.PARTITION.get(el), K.LATTICE.get(el), K.VALENCE.get(el), K.RADIUS.get(el),
                K.SSS_COEFF.get(el), K.POTENCY.get(el), K.FORMER_WEIGHT.get(el), K.SOLUBILITY.get(el)]
        rows.append(f"({idx}, '{el}', {', '.join(_num(c) for c in cols)})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") AS e(idx, component, a, md, rho, modulus, "
            "k, lat, vec, radius, sss, potency, former, solub)")


FIXTURE_SQL: dict[str, str] = {
    "f_element": _element_values(),
    "f_parts": """
        SELECT l_orderkey AS entity, l_partkey % 19 + 1 AS idx, sum(l_quantity) AS q
        FROM lineitem GROUP BY 1, 2""",
    "f_comp_long": """
        SELECT entity, component, q / sum(q) OVER (PARTITION BY entity) * 45.0::DOUBLE AS amount
        FROM f_parts JOIN f_element USING (idx)
        UNION ALL
        SELECT DISTINCT l_orderkey, 'Ni', 55.0::DOUBLE FROM lineitem""",
    "f_raw_long": """
        SELECT entity, component, amount * (0.853::DOUBLE + (entity % 40) / 100.0::DOUBLE) AS amount
        FROM f_comp_long""",
    "f_wide": "SELECT entity, sum(amount) AS total, " + ", ".join(
        f"coalesce(sum(amount) FILTER (component = '{e}'), 0) AS {e.lower()}"
        for e in ["Ni", *K.FIXTURE_COMPONENTS]) + " FROM f_comp_long GROUP BY entity",
    "f_raw_wide": "SELECT entity, sum(amount) AS total, " + ", ".join(
        f"coalesce(sum(amount) FILTER (component = '{e}'), 0) AS {e.lower()}"
        for e in ["Ni", *K.FIXTURE_COMPONENTS]) + " FROM f_raw_long GROUP BY entity",
    "f_entity": """
        SELECT o_orderkey AS entity,
          'ALLOY* ' || CAST(o_custkey % 300 AS VARCHAR) || CASE o_orderkey % 5 WHEN 0 THEN ' bar'
            WHEN 1 THEN '(SC)' WHEN 2 THEN ' cast' WHEN 3 THEN ' wrought' ELSE '' END AS name,
          CASE WHEN o_orderkey % 2 = 0 THEN 'wrought' ELSE 'cast' END AS route,
          o_orderstatus AS src,
          CASE o_orderkey % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW'
            ELSE 'UNKNOWN' END AS conf
        FROM orders""",
    "f_measurement": """
        SELECT *, row_number() OVER (PARTITION BY entity, property ORDER BY temp_c DESC) AS pos FROM (
          SELECT l_orderkey AS entity,
            CASE l_linenumber % 4 WHEN 0 THEN 'ys' WHEN 1 THEN 'uts' WHEN 2 THEN 'el' ELSE 'em' END AS property,
            CAST(20 + 93 * (l_suppkey % 13) AS INTEGER) AS temp_c,
            round(avg(l_extendedprice) / 100.0::DOUBLE, 6) AS value
          FROM lineitem GROUP BY 1, 2, 3)""",
    "f_pred": """
        SELECT arm, seed, entity, temp_c, property,
          CASE WHEN entity % 97 = 0 THEN 0.0::DOUBLE ELSE value END AS actual,
          value * (1 + ((entity * 31 + temp_c * 17 + arm * 7 + seed) % 41 - 20) / 100.0::DOUBLE) AS pred
        FROM f_measurement, (VALUES (0), (1), (2)) a(arm), (VALUES (42), (43), (44)) s(seed)
        WHERE NOT (arm = 2 AND entity % 17 = 0)""",
    "f_stratum": """
        SELECT entity, distance, CASE WHEN distance < 2 THEN 'NEAR' WHEN distance < 4.5 THEN 'MID'
          ELSE 'FAR' END AS stratum
        FROM (SELECT o_orderkey AS entity, (o_orderkey % 90) / 10.0::DOUBLE AS distance FROM orders)""",
    "f_interval": """
        SELECT entity, temp_c, property, actual, pred, pred - 0.15::DOUBLE * pred AS lower,
          pred + 0.15::DOUBLE * pred AS upper
        FROM f_pred WHERE arm = 0 AND seed = 42""",
    "f_ledger": """
        SELECT o_orderkey AS entity, 'composition' AS field,
          CASE o_orderkey % 3 WHEN 0 THEN 'Cr' WHEN 1 THEN 'Y' ELSE 'Al' END AS component,
          CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE (o_orderkey % 7) * 1.5::DOUBLE END AS to_value
        FROM orders WHERE o_orderkey % 50 = 0""",
    "f_job": """
        SELECT user_id AS key, CASE WHEN user_id % 2 = 0 THEN 'evaluate' ELSE 'design' END AS kind,
          CASE WHEN event_type = 'signup' THEN 'pending' WHEN event_type IN ('view', 'click') THEN 'running'
            WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS status,
          ts, props AS payload, event_id
        FROM events""",
    "f_question": """
        SELECT id, subtype,
          CASE WHEN id % 4 = 0 THEN c ELSE d1 END AS option_a,
          CASE WHEN id % 4 = 1 THEN c WHEN id % 4 > 1 THEN d2 ELSE d1 END AS option_b,
          CASE WHEN id % 4 = 2 THEN c WHEN id % 4 > 2 THEN d3 ELSE d2 END AS option_c,
          CASE WHEN id % 4 = 3 THEN c ELSE d3 END AS option_d,
          ['A', 'B', 'C', 'D'][id % 4 + 1] AS correct,
          CASE id % 5 WHEN 0 THEN 'I compared them.' || chr(10) || 'ANSWER: ' || letter
            WHEN 1 THEN '(' || letter || ') because it is larger'
            WHEN 2 THEN 'So **' || letter || ')** holds'
            WHEN 3 THEN 'the value is ' || d2 || ' MPa' ELSE 'no idea' END AS response
        FROM (SELECT p.p_partkey AS id, p.p_brand AS subtype, ['A', 'B', 'C', 'D'][p.p_partkey * 7 % 4 + 1] AS letter,
                printf('%.2f', p.p_retailprice) AS c, printf('%.2f', a.p_retailprice) AS d1,
                printf('%.2f', b.p_retailprice) AS d2, printf('%.2f', e.p_retailprice) AS d3
              FROM part p JOIN part a ON a.p_partkey = p.p_partkey + 1
              JOIN part b ON b.p_partkey = p.p_partkey + 2 JOIN part e ON e.p_partkey = p.p_partkey + 3)""",
    "f_answer": """
        SELECT p_partkey AS question_id, system, criterion,
          CASE WHEN (p_partkey + system * 3 + criterion * 5) % 11 = 0 THEN NULL
            ELSE CAST((p_partkey * 7 + system * 13 + criterion * 3) % 5 + 1 AS INTEGER) END AS score
        FROM part, (VALUES (0), (1), (2)) s(system), (VALUES (0), (1), (2)) c(criterion)""",
    # Features in long form: one pass for atomic shares, one for the phases, one for the sums.
    "f_at": """
        SELECT c.*, e.* EXCLUDE (component, idx), amount / a AS moles,
          amount / a / sum(amount / a) OVER (PARTITION BY entity) * 100 AS at_pct
        FROM f_comp_long c JOIN f_element e ON c.component = e.component""",
    "f_gp": """
        SELECT entity, greatest(0.0::DOUBLE, least(85.0::DOUBLE, 6.0::DOUBLE * least(
            greatest(0.0::DOUBLE, sum(at_pct * coalesce(former, 0)) - 2.0::DOUBLE - sum(at_pct * coalesce(solub, 0))),
            sum(at_pct) FILTER (component = 'Ni') / 3.6::DOUBLE))) AS gp
        FROM f_at GROUP BY entity""",
    "f_phase": """
        SELECT *, raw_g / sum(raw_g) OVER (PARTITION BY entity) * 100 AS at_g,
          raw_g * coalesce(k, 1.0) / sum(raw_g * coalesce(k, 1.0)) OVER (PARTITION BY entity) * 100 AS at_gp
        FROM (SELECT a.*, gp, at_pct / (fr * coalesce(k, 1.0) + 1 - fr) AS raw_g
              FROM f_at a JOIN (SELECT *, greatest(0.01::DOUBLE, least(0.90::DOUBLE, gp / 100)) AS fr FROM f_gp) g
              ON a.entity = g.entity)""",
    "f_feat": """
        SELECT *, 200 * (a_gp - a_g) / (a_gp + a_g) AS mismatch,
          CASE WHEN lvl = 3 OR (md_gamma > 0.980 AND lvl = 2) THEN 'Critical'
            WHEN lvl = 2 OR (md_gamma > 0.980 AND lvl = 1) THEN 'Elevated'
            WHEN lvl = 1 OR md_gamma > 0.980 THEN 'Moderate' ELSE 'Low' END AS tcp_risk
        FROM (SELECT p.*, CASE WHEN md_avg > 0.985 THEN 3 WHEN md_avg > 0.960 THEN 2
                WHEN md_avg > 0.940 THEN 1 ELSE 0 END AS lvl,
              sqrt(gp / 100) * (al_at + ti_at) / 100 * 10 AS ppt,
              CASE WHEN cr + al < 1 THEN 0 ELSE cr / (cr + al) * (least(cr, 15) + least(al, 8)) END AS oxidation,
              mo + w + nb + ta + re AS sss_wt, mo + w + ta + re + nb + hf AS refractory_wt,
              al + ti + ta + nb AS formers_wt
        FROM (
          SELECT entity, max(gp) AS gp, sum(at_pct * coalesce(md, 0)) / 100 AS md_avg,
            sum(at_g * coalesce(md, 0)) / 100 AS md_gamma, sum(at_pct * coalesce(vec, 0)) / 100 AS vec_avg,
            1 / sum(amount / 100 / coalesce(rho, 8.0)) AS density,
            3.524 + sum(at_g * coalesce(lat, 0)) / 100 AS a_g,
            3.524 + sum(at_gp * coalesce(lat, 0)) / 100 AS a_gp,
            sum(pow(at_g / 100, 0.67) * pow(abs(coalesce(radius, 1.246) - 1.246) / 1.246, 1.3) * coalesce(sss, 0)) AS sss_coeff,
            coalesce(sum(CASE component WHEN 'Re' THEN 2.0 WHEN 'Ru' THEN 1.5 WHEN 'W' THEN 1.0 END * at_pct), 0) AS creep,
            (sum(amount * modulus) / sum(amount) FILTER (modulus IS NOT NULL)
             + sum(amount) FILTER (modulus IS NOT NULL) / sum(amount / modulus)) / 2 AS vrh,
            coalesce(sum(amount * potency), 0) AS potency_sum,
            coalesce(sum(at_pct) FILTER (component = 'Al'), 0) AS al_at,
            coalesce(sum(at_pct) FILTER (component = 'Ti'), 0) AS ti_at,
            coalesce(sum(at_pct) FILTER (component IN ('Al', 'Ti', 'Ta', 'Nb')), 0) AS formers_at
          FROM f_phase GROUP BY entity) p JOIN f_wide USING (entity))""",
    "f_class": """
        SELECT w.*, route, name, conf,
          CASE WHEN al + ti + ta + 0.35::DOUBLE * nb < 2 THEN 'sss'
            WHEN route = 'cast' AND (re >= 2 OR (ru >= 1 AND re >= 1) OR (ta + w >= 10 AND re >= 1)
              OR (c < 0.06 AND ((ta + w >= 11 AND ta >= 5) OR ta >= 10 OR (ta + w >= 12 AND w >= 8))))
              THEN 'sc_ds' ELSE 'gp' END AS alloy_class
        FROM f_wide w JOIN f_entity USING (entity)""",
}
