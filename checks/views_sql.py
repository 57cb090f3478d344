"""The stand-in views in SQL, independent of the package: counts of generated trees are arithmetic here."""

from __future__ import annotations

import re

from tallyforge.rules.licenses import TEXTS
from checks.ruled_paths import CASES
from checks.snippets import CASES as SNIPPETS
from tallyforge.rules.languages import LANGUAGES

_MATCHED = """
        SELECT f.id AS repo, c.id AS spdx, count(*)::DOUBLE / (f.n + c.n - count(*)) AS confidence
        FROM (SELECT id, len(s) AS n, unnest(s) AS g FROM shingled WHERE kind = 'file') f
             JOIN (SELECT id, len(s) AS n, unnest(s) AS g FROM shingled WHERE kind = '{}') c ON f.g = c.g
        GROUP BY f.id, f.n, c.id, c.n"""


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# Whole words that tell a generated file.
_MARKED = "(^|\\W)(Code generated|@generated|DO NOT EDIT|Generated by the protocol buffer compiler|Autogenerated by Thrift Compiler|This file was automatically generated|GENERATED CODE)($|\\W)"

VIEWS: dict[str, str] = {
    "repos": """
        SELECT c_custkey::VARCHAR AS repo,
               CASE c_custkey % 3 WHEN 0 THEN 'github' WHEN 1 THEN 'gitlab' ELSE 'bitbucket' END AS provider,
               replace(c_name, '#', '-') AS slug,
               CASE c_custkey % 3 WHEN 1 THEN n_name || '/' || c_mktsegment ELSE c_mktsegment END AS project,
               'https://git.example/' || n_name || '/' || replace(c_name, '#', '-') AS url, n_name AS owner,
               c_acctbal < 0 AS archived, c_custkey % 10 = 0 AS fork
        FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "commits": """
        SELECT o_custkey::VARCHAR AS repo, o_orderkey::VARCHAR AS hash, o_orderkey AS nr, o_orderdate AS ts,
               o_orderdate + to_days(((o_orderkey % 5) * 40)::INTEGER) AS committer_ts,
               CASE WHEN o_orderkey % 13 = 0 THEN 'helper[bot] <Helper@bots.example>'
                    ELSE 'Dev <DEV' || (o_orderkey % 3) || '@E.com>' END AS author,
               CASE WHEN o_orderkey % 13 = 0 THEN 'helper@bots.example'
                    ELSE 'dev' || (o_orderkey % 3) || '@e.com' END AS identity,
               CASE o_orderkey % 11
                    WHEN 0 THEN 'Change ' || o_orderkey || chr(10) || chr(10) || '  Co-Authored-By: Claude <x@example.com>'
                    WHEN 1 THEN 'AI-Generated fix ' || o_orderkey || chr(10) || 'more'
                    WHEN 2 THEN 'Change ' || o_orderkey || chr(10) || 'Co-Authored-By: Jo Doe <jo@example.com>'
                    ELSE 'Change ' || o_orderkey END AS message
        FROM orders""",
    "signals": """
        SELECT repo, hash, nr, ts, author, message, split_part(message, chr(10), 1) AS first_line,
               concat_ws(',',
                   CASE WHEN len(list_filter(string_split(lower(message), chr(10)), lambda l:
                            starts_with(trim(l), 'co-authored-by:') AND (contains(l, 'claude') OR contains(l, 'copilot')
                            OR contains(l, 'cursor') OR contains(l, 'codeium') OR contains(l, 'gemini')
                            OR contains(l, 'chatgpt') OR contains(l, 'openai') OR contains(l, 'anthropic')
                            OR contains(l, 'windsurf') OR contains(l, 'aider') OR contains(l, 'amazon q')))) > 0
                        THEN 'co-author' END,
                   CASE WHEN lower(message) LIKE '%generated by%' OR lower(message) LIKE '%ai-generated%'
                          OR lower(message) LIKE '%ai-assisted%' OR lower(message) LIKE '%auto-generated%'
                        THEN 'commit-message' END,
                   CASE WHEN contains(lower(author), '[bot]') THEN 'bot-author' END) AS signals
        FROM commits""",
    "commit_files": """
        SELECT o_custkey::VARCHAR AS repo, l_orderkey::VARCHAR AS hash, 'p' || (l_partkey % 50) AS path,
               l_quantity::BIGINT AS additions, l_linenumber::BIGINT AS deletions
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "commit_stats": """
        SELECT repo, hash, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions
        FROM commit_files GROUP BY ALL""",
    "complexity": """
        SELECT o_custkey::VARCHAR AS repo, 'p' || (l_partkey % 50) AS path, sum(p_size)::BIGINT AS complexity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL""",
    "failures": """
        SELECT c_custkey::VARCHAR AS repo, stage, 'status ' || (400 + c_custkey % 100) AS error
        FROM customer, (VALUES ('files', 29), ('health', 31), ('ai-estimate', 37)) s(stage, m)
        WHERE c_custkey % m = 0""",
    "churn": """
        SELECT repo, path, count(*) AS changes, sum(additions)::BIGINT AS additions, sum(deletions)::BIGINT AS deletions
        FROM commit_files GROUP BY ALL""",
    "top_files": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY changes DESC, path)::INTEGER AS rank FROM churn)
        WHERE rank <= 20""",
    "tree_files": """
        SELECT o_custkey::VARCHAR AS repo, l_orderkey::VARCHAR AS commit_hash,
               CASE WHEN l_partkey % 17 = 0 OR l_partkey % 5 = 4 THEN NULL
                    WHEN l_partkey % 5 = 0 THEN 'Python' WHEN l_partkey % 5 = 1 THEN 'Go'
                    WHEN l_partkey % 5 = 2 THEN 'HTML' ELSE 'SQL' END AS language,
               (l_partkey % 17 = 0)::BIGINT AS filtered,
               l_quantity::BIGINT AS code,
               l_linenumber + CASE WHEN l_partkey % 5 IN (1, 2) THEN 1 ELSE 0 END AS comments,
               l_linenumber % 3 AS blanks,
               l_quantity::BIGINT * CASE l_partkey % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS complexity
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey % 19 <> 0""",
    "commit_languages": """
        SELECT repo, commit_hash, language, count(language) AS files,
               coalesce(sum(code + comments + blanks) FILTER (language IS NOT NULL), 0)::BIGINT AS lines,
               coalesce(sum(code) FILTER (language IS NOT NULL), 0)::BIGINT AS code,
               coalesce(sum(comments) FILTER (language IS NOT NULL), 0)::BIGINT AS comments,
               coalesce(sum(blanks) FILTER (language IS NOT NULL), 0)::BIGINT AS blanks,
               coalesce(sum(complexity) FILTER (language IS NOT NULL), 0)::BIGINT AS complexity,
               sum(filtered)::BIGINT AS filtered_files
        FROM tree_files GROUP BY ALL""",
    "repo_languages": """
        SELECT repo, language, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
               sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(complexity)::BIGINT AS complexity,
               sum(filtered_files)::BIGINT AS filtered_files
        FROM commit_languages GROUP BY ALL""",
    "totals": """
        SELECT r.repo, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(lines), 0)::BIGINT AS lines,
               coalesce(sum(code), 0)::BIGINT AS code, coalesce(sum(comments), 0)::BIGINT AS comments,
               coalesce(sum(blanks), 0)::BIGINT AS blanks, coalesce(sum(complexity), 0)::BIGINT AS complexity,
               coalesce(sum(filtered_files), 0)::BIGINT AS filtered_files
        FROM repos r LEFT JOIN repo_languages l ON r.repo = l.repo GROUP BY r.repo""",
    "languages": """
        SELECT language, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
               sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(complexity)::BIGINT AS complexity
        FROM repo_languages WHERE language IS NOT NULL GROUP BY ALL""",
    "portfolio": """
        SELECT count(*) AS repos, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines, sum(code)::BIGINT AS code,
               sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks, sum(complexity)::BIGINT AS complexity,
               sum(filtered_files)::BIGINT AS filtered_files
        FROM totals""",
    "ai": """
        SELECT r.repo, count(s.hash) AS total_commits, count(s.hash) FILTER (signals <> '') AS ai_commits,
               CASE WHEN count(s.hash) = 0 THEN 0 ELSE
                   count(s.hash) FILTER (signals <> '')::DOUBLE / count(s.hash) * 100 END AS commit_percent,
               coalesce(sum(x.additions) FILTER (signals <> ''), 0)::BIGINT AS ai_additions
        FROM repos r LEFT JOIN signals s ON r.repo = s.repo
             LEFT JOIN commit_stats x ON s.repo = x.repo AND s.hash = x.hash
        GROUP BY r.repo""",
    "good": "SELECT repo FROM repos WHERE repo NOT IN (SELECT repo FROM failures WHERE stage = 'files')",
    "now_": "SELECT TIMESTAMP '2001-08-31 10:00:00' AS now, TIMESTAMP '2001-03-03 10:00:00' AS six, TIMESTAMP '2000-08-31 10:00:00' AS twelve",
    "health": """
        SELECT r.repo,
               CASE WHEN f.error IS NOT NULL THEN 'failed' WHEN last IS NULL THEN 'abandoned'
                    WHEN days < 180 THEN 'active' WHEN days < 365 THEN 'maintained' ELSE 'abandoned' END AS category,
               CASE WHEN f.error IS NOT NULL OR last IS NULL THEN '' ELSE strftime(last, '%Y-%m-%dT%H:%M:%SZ') END AS last_commit_date,
               CASE WHEN f.error IS NOT NULL OR last IS NULL THEN -1 ELSE days END AS days_since_commit, f.error
        FROM repos r
             LEFT JOIN (SELECT repo, max(ts) AS last, greatest(floor(epoch(max(now) - max(ts)) / 86400), 0)::INTEGER AS days
                        FROM commits, now_ GROUP BY repo) c ON r.repo = c.repo
             LEFT JOIN (SELECT * FROM failures WHERE stage = 'health') f ON r.repo = f.repo""",
    "summary": """
        SELECT position, category, count(h.repo) AS repos, coalesce(sum(t.code), 0)::BIGINT AS code,
               CASE WHEN category = 'failed' THEN 0 ELSE coalesce(sum(t.code), 0)::DOUBLE * 100 /
                   (SELECT sum(t2.code) FROM health h2 JOIN totals t2 ON h2.repo = t2.repo WHERE h2.category <> 'failed') END AS code_percent
        FROM (VALUES (1, 'active'), (2, 'maintained'), (3, 'abandoned'), (4, 'failed')) d(position, category)
             LEFT JOIN health h USING (category) LEFT JOIN totals t ON h.repo = t.repo
        GROUP BY position, category""",
    "windows": """
        SELECT c.repo, CASE WHEN ts >= six THEN '0-6mo' WHEN ts >= twelve THEN '6-12mo' ELSE '12mo+' END AS "window",
               count(DISTINCT identity) AS authors, count(*) AS commits,
               coalesce(sum(additions), 0)::BIGINT AS additions, coalesce(sum(deletions), 0)::BIGINT AS deletions,
               coalesce(sum(additions) - sum(deletions), 0)::BIGINT AS net_churn
        FROM commits c CROSS JOIN now_ LEFT JOIN commit_stats s ON c.repo = s.repo AND c.hash = s.hash
        GROUP BY 1, 2""",
    "periods": """
        SELECT period_no::INTEGER AS period_no, strftime(d, '%Y-%m') AS period,
               d + INTERVAL 1 MONTH - INTERVAL 1 SECOND AS period_end
        FROM (SELECT (TIMESTAMP '2000-01-01' + to_months((i - 1)::INTEGER)) AS d, i AS period_no FROM range(1, 7) t(i))""",
    "snapshots": """
        SELECT repo, period_no, period, period_end,
               arg_max(hash, strftime(committer_ts, '%Y-%m-%dT%H:%M:%S.%f') || '#' || hash) AS commit_hash
        FROM periods JOIN commits ON ts <= period_end GROUP BY ALL""",
    "snapshot_trees": """
        SELECT * FROM snapshots WHERE commit_hash IN (SELECT l_orderkey::VARCHAR FROM lineitem)""",
    "trend_repo": """
        SELECT s.period_no, s.period, s.repo, coalesce(sum(files), 0)::BIGINT AS files, coalesce(sum(lines), 0)::BIGINT AS lines,
               coalesce(sum(code), 0)::BIGINT AS code, coalesce(sum(comments), 0)::BIGINT AS comments,
               coalesce(sum(blanks), 0)::BIGINT AS blanks, coalesce(sum(complexity), 0)::BIGINT AS complexity
        FROM snapshot_trees s LEFT JOIN commit_languages l ON s.repo = l.repo AND s.commit_hash = l.commit_hash
        GROUP BY ALL""",
    "trend_lang": """
        SELECT s.period_no, s.period, language, sum(files)::BIGINT AS files, sum(lines)::BIGINT AS lines,
               sum(code)::BIGINT AS code, sum(comments)::BIGINT AS comments, sum(blanks)::BIGINT AS blanks,
               sum(complexity)::BIGINT AS complexity
        FROM snapshot_trees s JOIN commit_languages l ON s.repo = l.repo AND s.commit_hash = l.commit_hash
        WHERE language IS NOT NULL GROUP BY ALL""",
    "trend_total": """
        SELECT p.period_no, p.period, count(t.repo) AS repos, coalesce(sum(files), 0)::BIGINT AS files,
               coalesce(sum(lines), 0)::BIGINT AS lines, coalesce(sum(code), 0)::BIGINT AS code,
               coalesce(sum(comments), 0)::BIGINT AS comments, coalesce(sum(blanks), 0)::BIGINT AS blanks,
               coalesce(sum(complexity), 0)::BIGINT AS complexity
        FROM periods p LEFT JOIN trend_repo t ON p.period_no = t.period_no GROUP BY ALL""",
    "trend_delta": """
        SELECT *, CASE WHEN lag(code) OVER (ORDER BY period_no) > 0
                       THEN code - lag(code) OVER (ORDER BY period_no) END AS code_delta FROM trend_total""",
    "sources": """
        SELECT source AS repo,
               CASE doc_id % 7 WHEN 0 THEN 'vendor/lib/' WHEN 1 THEN 'src/' ELSE '' END || 'doc' || doc_id ||
               CASE WHEN doc_id % 11 = 0 THEN '.pb.go' WHEN doc_id % 13 = 0 THEN '.js' WHEN lang = 'en' THEN '.py'
                    WHEN lang = 'de' THEN '.go' WHEN lang = 'fr' THEN '.ts' ELSE '.zzz' END AS path, text AS content
        FROM documents
        UNION ALL
        SELECT split_part(url, '/', 3), 'site/page' || page_id || '.html', replace(html, '>', '>' || chr(10)) FROM pages""",
    "source_status": """
        SELECT repo, path, content,
               CASE WHEN ends_with(path, '.py') THEN 'Python' WHEN ends_with(path, '.go') THEN 'Go'
                    WHEN ends_with(path, '.ts') THEN 'TypeScript' WHEN ends_with(path, '.js') THEN 'JavaScript'
                    WHEN ends_with(path, '.html') THEN 'HTML' END AS lang,
               CASE WHEN ends_with(path, '.pb.go') THEN 'filtered'
                    WHEN ends_with(path, '.js') AND length(content) > 110 * (
                         length(content) - length(replace(content, chr(10), '')) +
                         CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END) THEN 'filtered'
                    WHEN regexp_matches(content,
                         '(^|\\W)(Code generated|@generated|DO NOT EDIT|Generated by the protocol buffer compiler|Autogenerated by Thrift Compiler|This file was automatically generated|GENERATED CODE)($|\\W)')
                         THEN 'filtered'
                    WHEN ends_with(path, '.zzz') THEN 'unknown' ELSE 'counted' END AS status
        FROM sources WHERE NOT starts_with(path, 'vendor/')""",
    "source_lines": """
        SELECT repo, path, lang, no, line,
               CASE lang WHEN 'Python' THEN regexp_replace(line, '(")[^"]*"|('')[^'']*''|#.*', '\\1\\2', 'g')
                         WHEN 'HTML' THEN regexp_replace(line, '<!--.*?-->', '', 'g')
                         ELSE regexp_replace(line, '(")[^"]*"|('')[^'']*''|(`)[^`]*`|//.*', '\\1\\2\\3', 'g') END AS shown
        FROM (SELECT repo, path, lang, unnest(string_split(content, chr(10))) AS line,
                     generate_subscripts(string_split(content, chr(10)), 1) AS no,
                     len(string_split(content, chr(10))) AS n
              FROM source_status WHERE status = 'counted')
        WHERE NOT (no = n AND line = '')""",
    "source_blocks": """
        SELECT *, CASE WHEN lang = 'HTML' THEN coalesce(sum(step) OVER (PARTITION BY repo, path ORDER BY no
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END > 0 AS inside
        FROM (SELECT *, CASE WHEN contains(shown, '<!--') THEN 1 ELSE 0 END
                      - CASE WHEN contains(regexp_replace(shown, '<!--.*', ''), '-->') THEN 1 ELSE 0 END AS step FROM source_lines)""",
    "source_counts": """
        SELECT repo, path, lang AS language, count(*) AS lines,
               count(*) FILTER (kind = 'code') AS code, count(*) FILTER (kind = 'comment') AS comments,
               count(*) FILTER (kind = 'blank') AS blanks,
               coalesce(sum(branches), 0)::BIGINT AS complexity
        FROM (SELECT *, CASE WHEN trim(visible) <> '' THEN 'code' WHEN inside OR trim(line) <> '' THEN 'comment' ELSE 'blank' END AS kind,
                     len(regexp_extract_all(regexp_replace(visible, '(\\s)', '\\1\\1', 'g'),
                         CASE lang
                         WHEN 'Python' THEN '(?:^|\\s)(?:for |while |if |elif |else |else:|or |and |!= |== )'
                         WHEN 'Go' THEN '(?:^|\\s)(?:go |for |if |switch |select |else |\\|\\| |&& |!= |== )'
                         WHEN 'HTML' THEN '\\A\\z.'
                         ELSE '(?:^|\\s)(?:for |for\\(|if |if\\(|switch |switch\\(|while |while\\(|else |\\|\\| |&& |!= |== )' END)) AS branches
              FROM (SELECT *, CASE WHEN inside AND NOT contains(shown, '-->') THEN ''
                                   WHEN inside THEN regexp_replace(shown, '^.*?-->', '')
                                   WHEN lang = 'HTML' THEN regexp_replace(shown, '<!--.*$', '') ELSE shown END AS visible
                    FROM source_blocks))
        GROUP BY ALL""",
    "ruled": f"""
        SELECT 'doc' || doc_id AS repo, path, CASE WHEN status <> 'filtered' AND regexp_matches(text, '{_MARKED}') THEN 'filtered' ELSE status END AS status
        FROM documents JOIN (VALUES {", ".join(f"({i}, {_literal(path)}, {_literal(status) if status else 'NULL'})" for i, (path, _, status) in enumerate(CASES))}) t(kind, path, status)
             ON doc_id % {len(CASES)} = kind WHERE status IS NOT NULL""",
    "ambiguous": f"""
        SELECT 'doc' || doc_id AS repo, extension, CASE WHEN doc_id % 50 = 0 THEN '#!/usr/bin/env swipl' || chr(10) ELSE '' END || text || chr(10) || added AS text
        FROM documents JOIN (VALUES {", ".join(f"({i}, {_literal(e)}, {_literal(t)})" for i, (e, t) in enumerate(SNIPPETS))}) t(kind, extension, added) ON doc_id % {len(SNIPPETS)} = kind""",
    "signs": f"""
        SELECT * FROM (VALUES {", ".join(f"({_literal(key)}, {_literal(lang.name)}, {place}, {_literal(sign)}, {weight})" for place, lang in enumerate(LANGUAGES) for key in lang.keys for sign, weight in [*lang.signs.items(), ("", 0)])})
             s(extension, language, place, sign, weight)""",
    "notices": """
        SELECT * FROM (VALUES ('Apache-2.0', 'Licensed under the Apache License, Version 2.0.'),
                              ('CC-BY-4.0', 'Licensed under CC BY 4.0.'),
                              ('GPL-3.0', 'This work is licensed under the GNU General Public License, version 3.'),
                              ('MIT', 'Released under the MIT License.')) t(spdx, text)""",
    "corpus": f"""
        SELECT spdx, text, (row_number() OVER (ORDER BY spdx) - 1) AS kind
        FROM (VALUES {", ".join("(" + _literal(spdx) + ", " + _literal(text) + ")" for spdx, text in TEXTS.items())}) t(spdx, text)""",
    "license_files": """
        SELECT c_custkey::VARCHAR AS repo, array_to_string(list_transform(string_split(replace(text, '<owner>', c_name), ' '), lambda w, i:
                   CASE WHEN (i - 1 + c_custkey) % every = every - 1 THEN lower(c_mktsegment) ELSE w END), ' ') AS text
        FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN 1000000000 ELSE 12 + (c_custkey * 37) % 150 END AS every FROM customer) c
             JOIN corpus ON c_custkey % (SELECT count(*) FROM corpus) = kind""",
    "document_files": """SELECT 'doc' || doc_id AS repo, text FROM documents""",
    "candidates": """SELECT 'doc' || doc_id AS repo, text FROM documents UNION ALL SELECT repo, text FROM license_files""",
    "shingled": """
        SELECT kind, id, list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS s
        FROM (SELECT kind, id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '(?m)^[ \\t]*copyright\\b[^\\n]*', ' ', 'g'), '[^\\p{L}\\p{N}.]+'),
                                           lambda x: replace(x, '.', '') <> '') AS w
              FROM (SELECT 'file' AS kind, repo AS id, text FROM candidates UNION ALL SELECT 'corpus', spdx, text FROM corpus
                    UNION ALL SELECT 'notice', spdx, text FROM notices))""",
    "matches": f"""{_MATCHED.format("corpus")}""",
    "licenses": """
        SELECT repo, spdx AS license FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY confidence DESC, spdx) AS n
                                           FROM matches WHERE confidence >= 0.85) WHERE n = 1""",
    "mentions": f"""{_MATCHED.format("notice")}""",
}


def sql(query: str) -> str:
    """The query preceded by the views it uses, directly or through other views."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                needed.add(name)
                visit(VIEWS[name])

    visit(query)
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in VIEWS if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + query.strip()
