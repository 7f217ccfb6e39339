"""DuckDB SQL twins of the bindings, used as the correctness oracle.

``with_ctes(names, body)`` prefixes a query body with the named common table
expressions (and their dependencies) so each oracle string is self-contained.
"""

from __future__ import annotations

from gleaner.plans.bindings import AS_OF_SQL, BINDING_CONFIG, LINK_PREFIX


def _lit(v):
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def settings_sql(keys: dict[str, str]) -> str:
    """Per-source resolved settings as a VALUES table (source + one column per key),
    plus a row for sources without overrides under source ``NULL``... resolved with
    coalesce at use sites via ``setting(key)``."""
    cols = list(keys)
    rows = []
    for s, vals in BINDING_CONFIG.sources.items():
        rows.append("(" + ", ".join([_lit(s)] + [_lit(vals.get(k)) for k in cols]) + ")")
    names = ", ".join(["source"] + [f"s_{k}" for k in cols])
    return f"(SELECT * FROM (VALUES {', '.join(rows)}) t({names}))"


def setting(key: str, typ: str) -> str:
    """Resolved value expression for ``key`` given a joined alias ``c`` of settings_sql."""
    glob = BINDING_CONFIG.global_value(key)
    raw = f"coalesce(c.s_{key}, {_lit(glob)})"
    default = BINDING_CONFIG.defaults.get(key)
    if typ == "int":
        return (f"(CASE WHEN regexp_matches({raw}, '^\\s*[+-]?[0-9]+\\s*$') "
                f"THEN CAST(trim({raw}) AS INTEGER) ELSE {int(default)} END)")
    if typ == "double":
        return f"coalesce(TRY_CAST(trim({raw}) AS DOUBLE), {float(default)})"
    return raw


CTES: dict[str, tuple[list[str], str]] = {
    "landed": ([], f"""
        SELECT doc_id AS ord, lang AS source, '{LINK_PREFIX}' || md5(text) AS link,
               source || ' document ' || CAST(doc_id AS VARCHAR) AS title,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS creation_date,
               to_json({{'doc_id': doc_id, 'src': source, 'n_chars': n_chars, 'text': text}}) AS input,
               md5(lang || '|' || '{LINK_PREFIX}' || md5(text)) AS dedup_key
        FROM documents"""),
    "items": (["landed"], """
        SELECT * EXCLUDE (rn_) FROM (
          SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY ord) AS rn_
          FROM landed WHERE dedup_key IS NOT NULL) WHERE rn_ = 1"""),
    "evals": (["landed"], """
        SELECT l.dedup_key, e.event_id AS seq, CAST(dayofmonth(e.ts) AS INTEGER) AS round,
               e.event_type AS model, sha256(e.event_type) AS prompt_hash, e.ts AS eval_date,
               CAST(floor(least(e.value, 100.0)) AS INTEGER) AS importance_score,
               CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS confidence_score,
               CASE WHEN e.event_type = 'error' THEN ''
                    WHEN e.event_type = 'signup' THEN NULL
                    ELSE e.event_type || ' note ' || e.props END AS summary
        FROM events e JOIN landed l ON e.user_id = l.ord"""),
    "state": (["evals"], """
        SELECT dedup_key, count(*) AS num_evals,
               CASE WHEN sum(confidence_score + 100) > 0
                    THEN CAST(trunc(sum(CAST(importance_score AS BIGINT) * (confidence_score + 100))
                                    / sum(confidence_score + 100)) AS INTEGER)
                    ELSE 0 END AS weighted_score,
               CAST(trunc(median(confidence_score)) AS INTEGER) AS median_confidence,
               arg_max(eval_date, seq) AS last_eval
        FROM evals GROUP BY dedup_key"""),
    "store": (["items", "state"], """
        SELECT i.*, coalesce(s.num_evals, 0) AS num_evals, s.weighted_score,
               s.median_confidence, s.last_eval
        FROM items i LEFT JOIN state s USING (dedup_key)"""),
    "recent": (["store"], f"""
        SELECT st.* FROM store st LEFT JOIN {settings_sql({'lookback_days': 'int'})} c USING (source)
        WHERE {setting('lookback_days', 'int')} <= 0 OR st.creation_date IS NULL
           OR st.creation_date >= {AS_OF_SQL} - to_days({setting('lookback_days', 'int')})"""),
    "important": (["store"], f"""
        SELECT st.* FROM store st LEFT JOIN {settings_sql({'min_email_score': 'double'})} c USING (source)
        WHERE CAST(coalesce(st.weighted_score, 0) AS DOUBLE) >= {setting('min_email_score', 'double')}"""),
    "bulletin": (["recent", "important"], """
        SELECT *, row_number() OVER (ORDER BY weighted_score DESC NULLS LAST, ord) AS rank
        FROM (SELECT * FROM important WHERE dedup_key IN (SELECT dedup_key FROM recent))"""),
}


def with_ctes(names: list[str], body: str) -> str:
    """Prefix ``body`` with the named CTEs and their dependencies. A body that starts
    with ``, name AS (...)`` continues the CTE list with its own definitions."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    head = "WITH " + ",\n".join(parts)
    rest = body.lstrip()
    return head + (rest if rest.startswith(",") else "\n" + body)


CTES["responses"] = ([], """
    SELECT event_id, user_id, ts,
      CASE event_type
        WHEN 'view' THEN '{"summary": "s' || event_id || '", "evaluation": "e", "importance_score": '
             || CAST(floor(least(value, 100.0)) AS BIGINT) || ', "confidence_score": ' || json_extract_string(props, '$.k') || '}'
        WHEN 'click' THEN '{bad json ' || event_id
        WHEN 'purchase' THEN '{"evaluation": "e", "importance_score": ' || CAST(floor(least(value, 100.0)) AS BIGINT)
             || ', "confidence_score": ' || json_extract_string(props, '$.k') || '}'
        WHEN 'signup' THEN '{"summary": "s' || event_id || '", "evaluation": "e", "importance_score": "'
             || CAST(floor(least(value, 100.0)) AS BIGINT) || '", "confidence_score": ' || json_extract_string(props, '$.k') || '}'
        ELSE '{"summary": "s' || event_id || '", "evaluation": "e", "importance_score": '
             || CAST(floor(least(value, 100.0)) AS BIGINT) || ', "confidence_score": ' || json_extract_string(props, '$.k') || '.5}'
      END AS response_text
    FROM events""")

REASON_SQL = """CASE
      WHEN {t} IS NULL OR NOT json_valid({t}) THEN 'bad_json'
      WHEN json_type({t}) <> 'OBJECT'
           OR NOT list_has_all(json_keys({t}), ['summary', 'evaluation', 'importance_score', 'confidence_score'])
           THEN 'missing_key'
      WHEN coalesce(json_type({t}, '$.importance_score'), '') NOT IN ('UBIGINT', 'BIGINT') THEN 'non_int_importance'
      WHEN coalesce(json_type({t}, '$.confidence_score'), '') NOT IN ('UBIGINT', 'BIGINT') THEN 'non_int_confidence'
      ELSE 'valid' END"""

# Keyword scorer (gleaner.operators.scorers) in SQL over a text expression {x}.
def keyword_sql(x: str) -> dict[str, str]:
    from gleaner.operators.scorers import (INTEREST_TERMS, NEUTRAL_SCORE, OTHER_TERMS, RATE_SCALE,
                                           WORDS_PER_CONFIDENCE)
    tokens = f"regexp_extract_all(lower(coalesce({x}, '')), '[\\p{{L}}\\p{{N}}_]+')"
    terms_in = "[" + ", ".join(f"'{t}'" for t in INTEREST_TERMS) + "]"
    terms_out = "[" + ", ".join(f"'{t}'" for t in OTHER_TERMS) + "]"
    n = f"CAST(len({tokens}) AS BIGINT)"
    hin = f"CAST(len(list_filter({tokens}, lambda t: list_contains({terms_in}, t))) AS BIGINT)"
    hout = f"CAST(len(list_filter({tokens}, lambda t: list_contains({terms_out}, t))) AS BIGINT)"
    imp = (f"CAST(least(100, greatest(0, {NEUTRAL_SCORE} + ({hin} * {RATE_SCALE}) // ({n} + 1)"
           f" - ({hout} * {RATE_SCALE}) // ({n} + 1))) AS BIGINT)")
    conf = f"CAST(least(100, {n} // {WORDS_PER_CONFIDENCE}) AS BIGINT)"
    summary = f"'matched ' || {hin} || ' of ' || {n} || ' words'"
    return {"importance_score": imp, "confidence_score": conf, "summary": summary}
