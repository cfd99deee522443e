"""SQL for those queries of this folder that SQL can express."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from factloom.llm import decontaminate, quality_rules, url_graph


def _lower(text: str) -> str:
    return f"translate({text}, '{ascii_uppercase}', '{ascii_lowercase}')"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filter(rounds: int = url_graph.ROUNDS) -> str:
    """Rules, links, and each round of propagation as a table of its own."""
    rules = sorted(url_graph.RULES, key=lambda r: -len(r.name))
    fits = {
        r: f"(host = {_quoted(r.host)} OR ends_with(host, {_quoted('.' + r.host)}))"
        f" AND starts_with(path, {_quoted(r.path)})"
        for r in rules
    }
    rule = "CASE " + " ".join(f"WHEN {fits[r]} THEN {_quoted(r.name)}" for r in rules) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits[r]} THEN {_quoted(r.verdict)}" for r in rules) + " END"
    damping, weight = url_graph.DAMPING, url_graph.DOMAIN_WEIGHT
    steps = [
        f"""r{k} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
      SELECT e.kind, e.dst AS host, r.rank * e.share * {damping} AS rank
      FROM edges e JOIN r{k - 1} r ON e.kind = r.kind AND e.src = r.host
      UNION ALL SELECT kind, host, rank * {1 - damping} FROM r0) GROUP BY ALL)"""
        for k in range(1, rounds + 1)
    ]
    return f"""WITH cut AS (
      SELECT page_id, html,
        CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
    parts AS (
      SELECT page_id, html, coalesce({_lower("regexp_extract(rest, '^([^/?#]*)', 1)")}, '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut),
    judged AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict FROM parts),
    linked AS (
      SELECT src, {_lower("dst")} AS dst, 1.0 AS weight FROM (
        SELECT host AS src, unnest(regexp_extract_all(html, {_quoted(url_graph.ADDRESS)}, 1)) AS dst
        FROM parts WHERE host <> '')),
    hosts AS (SELECT DISTINCT host FROM (SELECT dst AS host FROM linked UNION ALL SELECT host FROM parts)),
    above AS (
      SELECT host, regexp_extract(host, '^[^.]*\\.([^.]+\\..+)$', 1) AS up FROM hosts),
    links AS (
      SELECT src, dst, sum(weight) AS weight FROM (
        SELECT * FROM linked UNION ALL SELECT host, up, {weight} FROM above WHERE up <> ''
        UNION ALL SELECT up, host, {weight} FROM above WHERE up <> '')
      WHERE src <> dst GROUP BY ALL),
    ways AS (SELECT 'trust' AS kind, src, dst, weight FROM links
      UNION ALL SELECT 'distrust', dst, src, weight FROM links),
    edges AS MATERIALIZED (
      SELECT kind, src, dst, weight / sum(weight) OVER (PARTITION BY kind, src) AS share FROM ways),
    seeds AS (
      SELECT CASE verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS mass
      FROM judged WHERE verdict IS NOT NULL AND host <> '' GROUP BY ALL),
    r0 AS MATERIALIZED (
      SELECT kind, host, mass / sum(mass) OVER (PARTITION BY kind) AS rank FROM seeds),
    {", ".join(steps)},
    ranks AS (
      SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS trust,
        coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS distrust FROM r{rounds} GROUP BY host)
    SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(distrust, 0)
      > coalesce(trust, 0) * {url_graph.RATIO} THEN 'block' ELSE 'allow' END) AS verdict
    FROM judged LEFT JOIN ranks USING (host)"""


def contamination(window: int = decontaminate.WINDOW) -> str:
    """Every window of every item against every run of as many document words."""
    pattern = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    words = f"regexp_extract_all({_lower("coalesce(text, '')")}, {pattern})"
    return f"""WITH docs AS (SELECT doc_id, {words} AS words FROM documents),
    items AS (SELECT item_id, {words} AS words FROM benchmark),
    sized AS (SELECT item_id, words, least({window}, len(words)) AS size FROM items WHERE len(words) > 0),
    windows AS (
      SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, size,
        array_to_string(words[k + 1 : k + size], ' ') AS run
      FROM sized, unnest(range(len(words) - size + 1)) AS u(k)),
    lengths AS (SELECT DISTINCT size FROM windows),
    runs AS (
      SELECT doc_id, k, size, array_to_string(words[k + 1 : k + size], ' ') AS run
      FROM docs, lengths, unnest(range(greatest(len(words) - size + 1, 0))) AS u(k)),
    met AS (SELECT doc_id, k, runs.size, item_id FROM runs JOIN windows USING (size, run)),
    hits AS (
      SELECT doc_id, count(DISTINCT p) AS n_hit
      FROM (SELECT DISTINCT doc_id, k, size FROM met), unnest(range(k, k + size)) AS u(p)
      GROUP BY doc_id),
    listed AS (
      SELECT doc_id, list_sort(list(DISTINCT item_id)) AS items FROM met GROUP BY doc_id)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
      CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
      sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
      coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def quality(rules: tuple[quality_rules.Rule, ...] = quality_rules.RULES) -> str:
    """Counts per document, windows as strings that are counted, and the same table of rules."""
    window = quality_rules.WINDOW
    stops = sorted({w for some in quality_rules.STOP_WORDS.values() for w in some})
    space = "'[\\x20\\x09-\\x0D]'"
    bare = f"regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
    bullets = " OR ".join(f"starts_with({bare}, {_quoted(b)})" for b in quality_rules.BULLETS)
    ends = " OR ".join(f"ends_with({bare}, {_quoted(b)})" for b in quality_rules.ELLIPSES)

    def broken(rule):
        sides = [
            f"1000 * {rule.part} {sign} {bound} * {rule.whole}"
            for sign, bound in (("<", rule.low), (">", rule.high))
            if bound is not None
        ]
        where = f"({' OR '.join(sides)}) AND n_words >= {rule.words}"
        if rule.languages:
            where += f" AND coalesce(lang IN ({', '.join(map(_quoted, rule.languages))}), false)"
        return f"({where})"

    return f"""WITH docs AS (
      SELECT doc_id, lang, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: {bare} <> '') AS lines
      FROM documents),
    windows AS (
      SELECT doc_id, k, array_to_string(words[k + 1 : k + {window}], ' ') AS run
      FROM docs, unnest(range(greatest(len(words) - {window - 1}, 0))) AS u(k)),
    again AS (
      SELECT doc_id, unnest(places) AS k FROM (
        SELECT doc_id, run, list(k) AS places FROM windows GROUP BY doc_id, run HAVING count(*) > 1)),
    covered AS (
      SELECT doc_id, count(DISTINCT p) AS n_repeat_words
      FROM again, unnest(range(k, k + {window})) AS u(p) GROUP BY doc_id),
    counted AS (
      SELECT doc_id, lang, len(words) AS n_words,
        CAST(length(regexp_replace(text, {space}, '', 'g')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(len(lines) AS BIGINT) AS n_lines,
        CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        len(list_filter(lines, lambda x: {bullets})) AS n_bullet_lines,
        len(list_filter(lines, lambda x: {ends})) AS n_ellipsis_lines,
        len(list_filter(words, lambda x: lower(x) IN ({', '.join(map(_quoted, stops))})))
          AS n_stop_words
      FROM docs),
    measured AS (
      SELECT *, coalesce(n_repeat_words, 0) AS again FROM counted LEFT JOIN covered USING (doc_id)),
    judged AS (
      SELECT *, n_words < {quality_rules.FEWEST}
        OR 100 * again > {quality_rules.REPEATED} * n_words AS base_failed FROM measured)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines,
      again AS n_repeat_words, base_failed,
      NOT base_failed AND NOT ({" OR ".join(map(broken, rules))}) AS kept FROM judged"""


ORACLES = {
    "op1_url_filter": url_filter(),
    "op9_decontamination": contamination(),
    "op11_quality_rules": quality(),
}
