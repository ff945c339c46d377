"""The registered queries as SQL for another engine, over the same tables."""

from __future__ import annotations

from patchloom.functions import prompts
from patchloom.functions.text import WHITESPACE
from patchloom.plans import queries as q
from patchloom.schemas import METRICS


def text(value: str) -> str:
    """A SQL string literal, control characters spelled as chr()."""
    parts, plain = [], ""
    for char in value:
        if char < " " or not char.isprintable():
            if plain:
                parts.append("'" + plain.replace("'", "''") + "'")
                plain = ""
            parts.append(f"chr({ord(char)})")
        else:
            plain += char
    if plain or not parts:
        parts.append("'" + plain.replace("'", "''") + "'")
    return "(" + " || ".join(parts) + ")"


NL = "chr(10)"

INSTANCE_ID = "d.source || '__' || d.lang || '-' || CAST(d.doc_id AS VARCHAR)"

# Each table and the tables it is made from.
TABLES = {
    "instances": (
        [],
        f"""
        SELECT b.*, CASE WHEN doc_id % 2 = 1 THEN patch ELSE '' END AS test_patch FROM (
          SELECT d.doc_id, {INSTANCE_ID} AS instance_id, d.source || '/' || d.lang AS repo,
            md5(CAST(d.doc_id AS VARCHAR)) AS base_commit, d.text AS problem_statement,
            '--- a/doc_' || d.doc_id || {NL} || '+++ b/doc_' || d.doc_id || {NL}
              || '@@ -1 +1 @@' || {NL}
              || array_to_string(list_transform(string_split(d.text, {NL}),
                   lambda l, k: (CASE (k - 1) % 3 WHEN 0 THEN '+' WHEN 1 THEN '-' ELSE ' ' END) || l),
                 {NL}) AS patch,
            CASE d.doc_id % 3 WHEN 1 THEN '' WHEN 2 THEN d.text END AS hints_text,
            CAST(NULL AS VARCHAR) AS created_at, CAST(NULL AS VARCHAR) AS version
          FROM documents d) b""",
    ),
    "predictions": (
        ["instances"],
        f"""
        SELECT i.doc_id, i.instance_id, 'm' || (i.doc_id % 2) AS model,
          CASE WHEN l.quality = 1 AND l.toxic = 0 THEN i.patch
               WHEN l.quality = 0 AND l.toxic = 1 THEN ''
               ELSE array_to_string(
                 list_slice(string_split(i.patch, {NL}), 1, len(string_split(i.patch, {NL})) // 2),
                 {NL}) END AS patch
        FROM instances i JOIN labels l USING (doc_id)""",
    ),
    "labelled": (
        [],
        f"""
        SELECT d.doc_id, d.n_chars, l.quality, l.toxic, {INSTANCE_ID} AS instance_id,
          d.source || '/' || d.lang AS repo, (l.quality = 1 AND l.toxic = 0) AS ok
        FROM documents d JOIN labels l USING (doc_id)""",
    ),
}


def _results(passed: str) -> str:
    return f"""
        SELECT doc_id, instance_id, repo, 'm' || (doc_id % 2) AS model, passed,
          CAST(n_chars % 7 + CAST(passed AS INTEGER) AS INTEGER) AS tests_passed,
          CAST(CASE WHEN passed THEN 0 ELSE 1 + doc_id % 3 END AS INTEGER) AS tests_failed,
          toxic AS tests_error, toxic = 0 AS patch_applied,
          CASE WHEN NOT passed THEN (CASE doc_id % 6 WHEN 1 THEN ''
            WHEN 2 THEN 'Failed to apply patch: x' WHEN 3 THEN 'Read Timeout'
            WHEN 4 THEN 'Docker daemon' WHEN 5 THEN 'boom' END) END AS error_message,
          n_chars / 8.0::DOUBLE AS execution_time
        FROM (SELECT *, {passed} AS passed FROM labelled)"""


TABLES["results"] = (["labelled"], _results("ok"))
TABLES["results_base"] = (
    ["labelled"],
    _results("CASE WHEN doc_id % 5 = 0 THEN NOT ok ELSE ok END"),
)
TABLES["responses"] = (
    [],
    f"""
        SELECT conv_id, turn, CASE conv_id % 4
          WHEN 0 THEN 'Sure. ' || text || {NL} || 'diff --git a/x b/x' || {NL} || '+' || text
            || {text(chr(10) + " " + chr(10))}
          WHEN 1 THEN {text("So:" + chr(10) + "--- a/x" + chr(10) + "+++ b/x" + chr(10) + "+")}
            || text || {NL}
          WHEN 2 THEN text || ' --- or +++ ' || text
          ELSE {text(chr(0x3000) + " " + chr(9))} || text || {text(" " + chr(0x1C) + chr(10))}
          END AS response
        FROM conversations WHERE role = 'assistant'""",
)
TABLES["logs"] = (
    [],
    f"""
        SELECT event_id, 'collected' || {NL} || '7 passed so far' || {NL} || '=== '
          || concat_ws(', ',
               CASE WHEN event_id % 3 > 0 THEN (event_id % 3) || ' failed' END,
               CASE WHEN user_id > 0 THEN user_id || ' passed' END,
               CASE WHEN event_id % 4 > 0 THEN (event_id % 4) || ' errors' END)
          || ' in 0.12s ===' AS log
        FROM events""",
)


def _rendered(template: str) -> str:
    out = text(template)
    for slot in ("repo", "problem_statement", "hints_text", "patch"):
        out = out.replace("{" + slot + "}", f"' || {slot} || '")
    return out


HEAD = _rendered(prompts.ISSUE_HEAD)
HINTS = f"CASE WHEN coalesce(hints_text, '') <> '' THEN {_rendered(prompts.HINTS_BLOCK)} ELSE '' END"
SFT_PROMPT = f"({HEAD} || {text(prompts.SFT_TAIL)})"
SFT_PROMPT_HINTS = f"({HEAD} || {HINTS} || {text(prompts.SFT_TAIL)})"
INFERENCE_PROMPT = f"({HEAD} || {HINTS} || {text(prompts.INFERENCE_TAIL)})"
SHORT_PROMPT = f"({HEAD} || {text(prompts.SHORT_TAIL)})"

TABLES["negatives"] = (
    ["instances"],
    f"""
        SELECT instance_id, repo, problem_statement, patch, ls,
          list_filter(ls, lambda l, k: NOT list_contains(dropped, k)) AS kept, dropped
        FROM (SELECT *, list_filter(changed, lambda c, j: j % 3 = 0) AS dropped
          FROM (SELECT *, list_filter(range(1, len(ls) + 1), lambda k:
              (ls[k][1:1] IN ('+', '-')) AND ls[k][1:3] NOT IN ('+++', '---')) AS changed
            FROM (SELECT *, string_split(patch, {NL}) AS ls FROM instances)))""",
)
TABLES["rule_pairs"] = (
    ["negatives"],
    f"""
        SELECT {SFT_PROMPT} AS prompt, patch AS chosen,
          array_to_string(ls[1:len(ls) // 2], {NL}) AS rejected, instance_id,
          'truncate' AS strategy
        FROM negatives WHERE len(ls) > 5
        UNION ALL
        SELECT {SFT_PROMPT}, patch, array_to_string(kept, {NL}), instance_id, 'drop_lines'
        FROM negatives WHERE len(ls) > 10 AND len(dropped) > 0""",
)


def _eval_pairs(default: str, predicted: str = "predictions") -> str:
    return f"""
        SELECT {SFT_PROMPT} AS prompt, i.patch AS chosen, p.patch AS rejected, instance_id,
          'evaluation' AS strategy
        FROM instances i
          JOIN (SELECT instance_id, patch FROM {predicted}) p USING (instance_id)
          LEFT JOIN (SELECT instance_id, passed FROM results) r USING (instance_id)
        WHERE NOT coalesce(passed, {default})"""


# The prompt only needs these columns, and `patch` would be ambiguous in joins.
_UNTESTED = """(SELECT instance_id, patch FROM predictions UNION ALL
            SELECT instance_id, 'untested ' || doc_id FROM instances
            WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL))"""
_EVAL = {
    "strict": _eval_pairs("true", _UNTESTED),
    "lenient": _eval_pairs("false", _UNTESTED),
    "all": _eval_pairs("false"),
}
_EVAL = {k: v.replace("|| patch ||", "|| i.patch ||") for k, v in _EVAL.items()}

RATE_ROWS = """
          count(*) AS total_instances,
          count(*) FILTER (passed) AS resolved,
          count(*) FILTER (patch_applied) AS patches_applied,
          count(*) - count(*) FILTER (patch_applied) AS patches_failed,
          CAST(coalesce(sum(tests_passed), 0) AS BIGINT) AS total_tests_passed,
          CAST(coalesce(sum(tests_failed), 0) AS BIGINT) AS total_tests_failed,
          CAST(coalesce(sum(tests_error), 0) AS BIGINT) AS total_tests_error,
          CAST(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (passed) / count(*) END AS DOUBLE)
            AS resolve_rate,
          CAST(CASE WHEN count(*) = 0 THEN 0 ELSE count(*) FILTER (patch_applied) / count(*) END
            AS DOUBLE) AS patch_apply_rate,
          CAST(CASE WHEN count(*) = 0 THEN 0 ELSE sum(execution_time) / count(*) END AS DOUBLE)
            AS avg_execution_time,
          CAST(coalesce(sum(execution_time), 0) AS DOUBLE) AS total_execution_time"""


def _last_count(pattern: str) -> str:
    return (
        f"coalesce(TRY_CAST(regexp_extract_all(log, '{pattern}', 1)[-1] AS INTEGER), 0)"
    )


COUNTED = f"""SELECT event_id, {_last_count("([0-9]+) passed")} AS passed,
          {_last_count("([0-9]+) failed")} AS failed,
          {_last_count("([0-9]+) errors?")} AS errors
        FROM logs"""

UNSUPPORTED = " OR ".join(
    f"starts_with(instance_id, '{repo.replace('/', '__')}')" for repo in q.UNSUPPORTED
)

FULL_ROW = """instance_id, repo, base_commit, problem_statement, patch, test_patch, hints_text,
          created_at, version"""


def _seeded(width: int) -> str:
    return f"md5('42|' || instance_id)[1:{width}]"


def _resolved(table: str) -> str:
    return f"(SELECT instance_id FROM {table} WHERE passed)"


# name → (tables it starts from, SQL)
STATEMENTS: dict[str, tuple[list[str], str]] = {
    "instances_normalize": (["instances"], f"SELECT {FULL_ROW} FROM instances"),
    "filter_patch_length": (
        ["instances"],
        """SELECT instance_id, CAST(length(patch) AS BIGINT) AS patch_length FROM instances
        WHERE length(patch) <= 8000""",
    ),
    "sft_prompt": (["instances"], f"SELECT instance_id, {SFT_PROMPT} AS prompt FROM instances"),
    "sft_prompt_hints": (
        ["instances"],
        f"SELECT instance_id, {SFT_PROMPT_HINTS} AS prompt FROM instances",
    ),
    "inference_prompt": (
        ["instances"],
        f"SELECT instance_id, {INFERENCE_PROMPT} AS prompt FROM instances",
    ),
    "sft_text_short": (
        ["instances"],
        f"""SELECT instance_id, {SHORT_PROMPT} AS prompt, {SHORT_PROMPT} || patch AS text
        FROM instances""",
    ),
    "prompt_from_template": (
        ["instances"],
        f"""SELECT instance_id, {SFT_PROMPT} || patch || {NL} AS prompt,
          {_rendered(prompts.PROSE_TEMPLATE)} AS prose_prompt FROM instances""",
    ),
    "sft_format": (
        ["instances"],
        f"""SELECT instance_id, {SFT_PROMPT} AS prompt, patch AS completion,
          {SFT_PROMPT} || patch AS text FROM instances WHERE length(patch) <= 8000""",
    ),
    "first_n": (
        ["instances"],
        """SELECT instance_id, repo, greatest((SELECT count(*) FROM instances) - 20, 0) AS n_more
        FROM (SELECT instance_id, repo FROM instances ORDER BY instance_id LIMIT 20)""",
    ),
    "instance_lookup": (
        ["instances"],
        f"SELECT {FULL_ROW} FROM instances WHERE instance_id = '{q.LOOKUP_ID}'",
    ),
    "image_manifest": (
        ["instances"],
        f"""SELECT instance_id,
          '{q.IMAGE_PREFIX}:' || split_part(repo, '/', 1) || '.' || split_part(repo, '/', 2) || '-'
            || replace(repo, '/', '__') || '-' || base_commit AS image,
          '{q.IMAGE_PREFIX}:solo.solo-solo__solo-' || base_commit AS image_of_bare_repo
        FROM instances""",
    ),
    "extract_patch": (
        ["responses"],
        f"""SELECT conv_id, turn, CASE
          WHEN contains(response, 'diff --git')
            THEN trim(substr(response, strpos(response, 'diff --git')), {text(WHITESPACE)})
          WHEN contains(response, '---') AND contains(response, '+++')
            THEN CASE WHEN starts_with(response, '---') THEN response
              WHEN contains(response, {text(chr(10) + "---")})
                THEN substr(response, strpos(response, {text(chr(10) + "---")}) + 1)
              ELSE '' END
          ELSE trim(response, {text(WHITESPACE)}) END AS patch
        FROM responses""",
    ),
    "strip_text": (
        ["responses"],
        f"SELECT conv_id, turn, trim(response, {text(WHITESPACE)}) AS stripped FROM responses",
    ),
    "strip_prompt_echo": (
        ["instances"],
        f"""SELECT instance_id, trim(CASE WHEN starts_with(generated, prompt)
            THEN substr(generated, length(prompt) + 1) ELSE generated END,
            {text(WHITESPACE)}) AS patch
        FROM (SELECT instance_id, prompt, CASE doc_id % 3
            WHEN 0 THEN prompt || {text(" " + chr(10))} || patch || {NL}
            WHEN 1 THEN patch ELSE prompt END AS generated
          FROM (SELECT *, {SHORT_PROMPT} AS prompt FROM instances))""",
    ),
    "prediction_preview": (
        ["predictions"],
        """SELECT instance_id, CASE WHEN length(patch) > 500
            THEN substr(patch, 1, 500) || '...(truncated)' ELSE patch END AS preview,
          CAST(greatest(length(patch) - 500, 0) AS BIGINT) AS more_chars
        FROM predictions""",
    ),
    "log_tail": (
        [],
        f"""SELECT {INSTANCE_ID} AS instance_id,
          CASE WHEN length(d.text) > 5000 THEN substr(d.text, length(d.text) - 4999)
            ELSE d.text END AS logs,
          CASE WHEN length(d.text) > 1000 THEN substr(d.text, length(d.text) - 999)
            ELSE d.text END AS preview
        FROM documents d""",
    ),
    "parse_test_log": (["logs"], COUNTED),
    "result_verdict": (
        ["logs"],
        f"""SELECT event_id, failed = 0 AND errors = 0 AND passed > 0 AS resolved
        FROM ({COUNTED})""",
    ),
    "repo_from_id": (
        ["results"],
        """SELECT instance_id, replace(split_part(instance_id, '-', 1), '__', '/') AS repo
        FROM results""",
    ),
    "error_bucket": (
        ["results"],
        """SELECT instance_id, CASE WHEN coalesce(error_message, '') = '' THEN NULL
          WHEN lower(error_message) LIKE '%patch%' THEN 'patch_apply_failed'
          WHEN lower(error_message) LIKE '%timeout%' THEN 'timeout'
          WHEN lower(error_message) LIKE '%docker%' THEN 'docker_error'
          ELSE 'other' END AS error_type FROM results""",
    ),
    "reward": (
        ["results"],
        """SELECT instance_id, CASE WHEN passed THEN 1 WHEN patch_applied THEN 0 ELSE -1 END
          AS reward FROM results""",
    ),
    "json_roundtrip": (
        ["predictions"],
        f"""SELECT instance_id, patch AS model_patch, '{q.MODEL_NAME}' AS model_name_or_path
        FROM predictions""",
    ),
    "diff_lines": (
        ["instances"],
        f"""SELECT instance_id, CAST(k - 1 AS INTEGER) AS pos, ls[k] AS line,
          CASE WHEN ls[k][1:3] IN ('+++', '---') THEN 'header' WHEN ls[k][1:1] = '+' THEN 'added'
            WHEN ls[k][1:1] = '-' THEN 'removed' ELSE 'context' END AS kind
        FROM (SELECT instance_id, ls, unnest(range(1, len(ls) + 1)) AS k
          FROM (SELECT instance_id, string_split(patch, {NL}) AS ls FROM instances))""",
    ),
    "diff_line_counts": (
        ["instances"],
        f"""SELECT instance_id, CAST(len(ls) AS INTEGER) AS n_lines,
          CAST(len(list_filter(ls, lambda l: l[1:1] = '+' AND l[1:3] <> '+++')) AS INTEGER)
            AS n_added,
          CAST(len(list_filter(ls, lambda l: l[1:1] = '-' AND l[1:3] <> '---')) AS INTEGER)
            AS n_removed,
          CAST(len(list_filter(ls, lambda l: l[1:3] IN ('+++', '---'))) AS INTEGER) AS n_header
        FROM (SELECT instance_id, string_split(patch, {NL}) AS ls FROM instances)""",
    ),
    "neg_truncate": (
        ["negatives"],
        f"""SELECT instance_id, array_to_string(ls[1:len(ls) // 2], {NL}) AS rejected
        FROM negatives WHERE len(ls) > 5""",
    ),
    "neg_drop_every_third": (
        ["negatives"],
        f"""SELECT instance_id, array_to_string(kept, {NL}) AS rejected
        FROM negatives WHERE len(ls) > 10 AND len(dropped) > 0""",
    ),
    "neg_swap_signs": (
        ["instances"],
        f"""SELECT instance_id, array_to_string(list_transform(string_split(patch, {NL}), lambda l:
            CASE WHEN l[1:3] IN ('+++', '---') THEN l
              WHEN l[1:1] = '+' THEN '-' || substr(l, 2)
              WHEN l[1:1] = '-' THEN '+' || substr(l, 2) ELSE l END), {NL}) AS rejected
        FROM instances""",
    ),
    "pairs_rule_based": (["rule_pairs"], "SELECT * FROM rule_pairs"),
    "pairs_eval_strict": (["predictions", "results"], _EVAL["strict"]),
    "pairs_eval_lenient": (["predictions", "results"], _EVAL["lenient"]),
    "pairs_hybrid": (
        ["predictions", "results", "rule_pairs"],
        f"{_EVAL['all']} UNION ALL SELECT * FROM rule_pairs",
    ),
    "pair_counts_by_strategy": (
        ["predictions", "results", "rule_pairs"],
        f"""SELECT strategy, count(*) AS n_pairs
        FROM ({_EVAL["all"]} UNION ALL SELECT * FROM rule_pairs) GROUP BY strategy""",
    ),
    "dpo_format": (
        ["predictions", "results"],
        f"SELECT prompt, chosen, rejected FROM ({_EVAL['lenient']})",
    ),
    "pairs_from_candidates": (
        ["instances"],
        f"""SELECT {SFT_PROMPT} AS prompt, patch AS chosen, rejected, instance_id,
          'synthetic' AS strategy
        FROM (SELECT *, trim(response, {text(WHITESPACE)}) AS rejected
          FROM (SELECT *, CASE WHEN attempt = 0 THEN patch
              WHEN attempt = 1 THEN {text(" " + chr(10))} || patch || {text(chr(10) + "+extra" + chr(10))}
              WHEN doc_id % 4 <> 0 THEN 'diff ' || patch END AS response
            FROM instances, (SELECT unnest(range(3)) AS attempt))
          WHERE coalesce(response, '') <> '')
        WHERE rejected <> patch""",
    ),
    "pairs_pass_fail": (
        ["instances", "predictions"],
        f"""SELECT {SFT_PROMPT} AS prompt, c.patch AS chosen, f.patch AS rejected,
          instance_id, 'pass_fail' AS strategy
        FROM (SELECT instance_id, repo, problem_statement FROM instances)
          JOIN (SELECT instance_id, arg_min(patch, attempt) AS patch FROM attempts
            WHERE passed GROUP BY instance_id) c USING (instance_id)
          JOIN (SELECT instance_id, patch FROM attempts WHERE NOT passed) f USING (instance_id)""",
    ),
    "predictions_nonempty": (
        ["predictions"],
        "SELECT instance_id, patch FROM predictions WHERE coalesce(patch, '') <> ''",
    ),
    "predictions_dedup_last": (["predictions"], "SELECT instance_id, patch FROM predictions"),
    "instances_with_predictions": (
        ["instances", "predictions"],
        """SELECT instance_id, repo, patch FROM instances
        WHERE instance_id IN (SELECT instance_id FROM predictions)""",
    ),
    "eval_worklist": (
        ["instances", "predictions"],
        """SELECT i.instance_id, i.repo, i.base_commit, i.test_patch, i.patch,
          p.patch AS model_patch
        FROM instances i JOIN predictions p USING (instance_id)
        WHERE coalesce(p.patch, '') <> ''""",
    ),
    "gold_predictions": (["instances"], "SELECT instance_id, patch FROM instances"),
    "submission_format": (
        ["predictions"],
        f"""SELECT instance_id, patch AS model_patch, '{q.MODEL_NAME}' AS model_name_or_path
        FROM predictions""",
    ),
    "filter_unsupported": (
        ["predictions"],
        f"SELECT instance_id, patch FROM predictions WHERE NOT ({UNSUPPORTED})",
    ),
    "filter_unsupported_counts": (
        ["predictions"],
        f"""SELECT ({UNSUPPORTED}) AS is_unsupported, count(*) AS n_predictions
        FROM predictions GROUP BY 1""",
    ),
    "run_summary": (
        ["predictions"],
        """SELECT model, count(*) AS n_predictions, 'lite' AS dataset
        FROM predictions GROUP BY model""",
    ),
    "run_samples": (
        ["predictions"],
        """SELECT instance_id, CASE WHEN length(patch) > 300 THEN substr(patch, 1, 300) || '...'
          ELSE patch END AS sample FROM predictions ORDER BY instance_id LIMIT 3""",
    ),
    "read_prediction_arrays": (["predictions"], "SELECT instance_id, patch FROM predictions"),
    "read_prediction_objects": (["predictions"], "SELECT instance_id, patch FROM predictions"),
    "read_result_bundle": (
        ["results"],
        """SELECT instance_id, passed, tests_passed, tests_failed, tests_error, patch_applied,
          error_message, execution_time, '"results": [{}], ' || chr(92) || '"' || instance_id AS logs
        FROM results""",
    ),
    "read_bundle_metrics": (["results"], f"SELECT {RATE_ROWS} FROM results"),
    "metrics_global": (["results"], f"SELECT {RATE_ROWS} FROM results"),
    "metrics_empty": (["results"], f"SELECT {RATE_ROWS} FROM results WHERE execution_time < 0"),
    "metrics_per_repo": (
        ["results"],
        """SELECT replace(split_part(instance_id, '-', 1), '__', '/') AS repo, count(*) AS total,
          count(*) FILTER (passed) AS resolved,
          CAST(count(*) FILTER (passed) / count(*) AS DOUBLE) AS resolve_rate
        FROM results GROUP BY 1 ORDER BY 1""",
    ),
    "metrics_per_repo_joined": (
        ["results"],
        """SELECT repo, count(*) AS total, count(*) FILTER (passed) AS resolved,
          CAST(count(*) FILTER (passed) / count(*) AS DOUBLE) AS resolve_rate
        FROM results GROUP BY repo ORDER BY repo""",
    ),
    "metrics_error_types": (
        ["results"],
        """SELECT CASE WHEN lower(error_message) LIKE '%patch%' THEN 'patch_apply_failed'
          WHEN lower(error_message) LIKE '%timeout%' THEN 'timeout'
          WHEN lower(error_message) LIKE '%docker%' THEN 'docker_error'
          ELSE 'other' END AS error_type, count(*) AS n_results
        FROM results WHERE error_message <> '' GROUP BY 1 ORDER BY 1""",
    ),
    "metrics_secondary": (
        ["results"],
        """SELECT CAST(sum(tests_passed) / sum(tests_passed + tests_failed + tests_error) AS DOUBLE)
            AS tests_passed_rate,
          round(avg(CAST(tests_passed AS DOUBLE)
            / nullif(tests_passed + tests_failed + tests_error, 0)), 9) AS mean_tests_passed_rate,
          CAST(count(*) FILTER (passed AND patch_applied) / count(*) FILTER (patch_applied)
            AS DOUBLE) AS resolved_of_applied_rate
        FROM results""",
    ),
    "metrics_coverage": (
        ["results", "instances"],
        """SELECT count(DISTINCT instance_id) AS evaluated,
          (SELECT count(DISTINCT instance_id) FROM instances) AS instances,
          CAST(count(DISTINCT instance_id) / (SELECT count(DISTINCT instance_id) FROM instances)
            AS DOUBLE) AS coverage
        FROM results""",
    ),
    "resolved_ids": (["results"], "SELECT instance_id FROM results WHERE passed"),
    "resolved_top20": (
        ["results"],
        """SELECT instance_id,
          greatest((SELECT count(*) FROM results WHERE passed) - 20, 0) AS n_more
        FROM (SELECT instance_id FROM results WHERE passed ORDER BY instance_id LIMIT 20)""",
    ),
    "gold_validation": (
        ["results"],
        """SELECT count(*) FILTER (passed) AS passed, count(*) AS total,
          CAST(count(*) FILTER (passed) / count(*) AS DOUBLE) AS rate,
          bool_and(passed) AS all_passed FROM results""",
    ),
    "leaderboard": (
        ["results"],
        """SELECT model, 'Direct Generation' AS method, count(*) FILTER (passed) AS resolved,
          count(*) AS total,
          round(CAST(count(*) FILTER (passed) / count(*) AS DOUBLE) * 100, 2) AS resolve_rate,
          round(CAST(count(*) FILTER (patch_applied) / count(*) AS DOUBLE) * 100, 2)
            AS patch_apply_rate
        FROM results GROUP BY model""",
    ),
    "model_card_metrics": (
        ["instances", "results"],
        """SELECT repo, coalesce(CAST(resolved AS VARCHAR), 'N/A') AS resolved,
          coalesce(CAST(resolve_rate AS VARCHAR), 'N/A') AS resolve_rate,
          'N/A' AS patches_applied
        FROM (SELECT DISTINCT repo FROM instances) LEFT JOIN (
          SELECT repo, count(*) FILTER (passed) AS resolved,
            round(CAST(count(*) FILTER (passed) / count(*) AS DOUBLE) * 100, 2) AS resolve_rate
          FROM results GROUP BY repo) USING (repo)""",
    ),
    "cmp_new_resolved": (
        ["results", "results_base"],
        f"""SELECT instance_id FROM {_resolved("results")}
        WHERE instance_id NOT IN {_resolved("results_base")}""",
    ),
    "cmp_regressions": (
        ["results", "results_base"],
        f"""SELECT instance_id FROM {_resolved("results_base")}
        WHERE instance_id NOT IN {_resolved("results")}""",
    ),
    "cmp_both_resolved": (
        ["results", "results_base"],
        f"""SELECT instance_id FROM {_resolved("results")}
        WHERE instance_id IN {_resolved("results_base")}""",
    ),
    "cmp_summary": (
        ["results", "results_base"],
        """SELECT t.resolved - b.resolved AS resolved_improvement,
          CAST(t.resolved / t.total AS DOUBLE) - CAST(b.resolved / b.total AS DOUBLE)
            AS resolve_rate_improvement,
          t.applied - b.applied AS patch_apply_improvement,
          n_new_resolved, n_regressions, n_both_resolved,
          n_new_resolved - n_regressions AS net_improvement
        FROM (SELECT count(*) FILTER (passed) AS resolved, count(*) AS total,
            count(*) FILTER (patch_applied) AS applied FROM results) t,
          (SELECT count(*) FILTER (passed) AS resolved, count(*) AS total,
            count(*) FILTER (patch_applied) AS applied FROM results_base) b,
          (SELECT count(*) FILTER (t.passed AND NOT b.passed) AS n_new_resolved,
            count(*) FILTER (b.passed AND NOT t.passed) AS n_regressions,
            count(*) FILTER (b.passed AND t.passed) AS n_both_resolved
          FROM results t JOIN results_base b USING (instance_id))""",
    ),
    "cmp_document": (
        ["results", "results_base"],
        """SELECT 'base.json' AS base_path, b.resolved AS base_resolved,
          'tuned.json' AS tuned_path, t.resolved AS tuned_resolved,
          t.resolved - b.resolved AS resolved_delta,
          CAST(t.resolved / t.total AS DOUBLE) - CAST(b.resolved / b.total AS DOUBLE)
            AS resolve_rate_delta
        FROM (SELECT count(*) FILTER (passed) AS resolved, count(*) AS total FROM results) t,
          (SELECT count(*) FILTER (passed) AS resolved, count(*) AS total FROM results_base) b""",
    ),
    "train_test_split": (
        ["instances"],
        f"""SELECT instance_id, repo, CASE WHEN n > 100 AND place <= ceil(n * 0.1::DOUBLE)
            THEN 'test' ELSE 'train' END AS split
        FROM (SELECT instance_id, repo, count(*) OVER () AS n,
            row_number() OVER (ORDER BY {_seeded(32)}) AS place
          FROM instances)""",
    ),
    "train_test_split_pairs": (
        ["instances"],
        f"""SELECT split, CAST(sum(n_rows) AS BIGINT) AS n_rows
        FROM (SELECT unnest(['test', 'train']) AS split,
            unnest([CAST(ceil(n * 0.1::DOUBLE) AS BIGINT),
              n - CAST(ceil(n * 0.1::DOUBLE) AS BIGINT)]) AS n_rows
          FROM (SELECT CAST(sum(len(string_split(patch, {NL}))) AS BIGINT) AS n FROM instances))
        GROUP BY split""",
    ),
    "train_test_split_hash": (
        ["instances"],
        f"""SELECT instance_id, repo,
          CASE WHEN {_seeded(8)} < '19999999' THEN 'test' ELSE 'train' END AS split
        FROM instances""",
    ),
    "candidate_requests": (
        ["instances"],
        f"""SELECT instance_id, CAST(attempt AS INTEGER) AS attempt,
          0.7::DOUBLE + attempt * 0.1::DOUBLE AS temperature,
          {SFT_PROMPT} || {text(prompts.NEGATIVE_REQUESTS["flaw_list"].removeprefix("{prompt}"))}
            AS request
        FROM instances, (SELECT unnest(range(3)) AS attempt)""",
    ),
    "batch_generate_stub": (
        ["instances"],
        f"""SELECT instance_id,
          CASE WHEN n % 5 = 0 THEN '' ELSE 'diff --git a/x b/x' || {NL} || '+' || n END AS patch,
          CASE WHEN n % 5 = 0 THEN 'model gave up' END AS error
        FROM (SELECT instance_id, length({INFERENCE_PROMPT}) AS n FROM instances)""",
    ),
    "generation_summary": (
        ["instances"],
        f"""SELECT count(*) AS processed, count(*) FILTER (n % 5 <> 0) AS successful,
          count(*) FILTER (n % 5 = 0) AS failed
        FROM (SELECT length({INFERENCE_PROMPT}) AS n FROM instances)""",
    ),
}

TABLES["many_attempts"] = (
    ["predictions"],
    """
        SELECT instance_id, attempt, patch || attempt AS patch, (doc_id + attempt * attempt) % 3 = 0 AS passed
        FROM predictions, (SELECT unnest(range(7)) AS attempt) WHERE attempt <= doc_id % 7""",
)
TABLES["matched"] = (
    ["many_attempts"],
    """
        SELECT instance_id, i AS pair, CAST(a.attempt AS INTEGER) AS passing_attempt,
          CAST(b.attempt AS INTEGER) AS failing_attempt,
          a.patch AS chosen, b.patch AS rejected
        FROM (SELECT instance_id, p, f, unnest(range(greatest(p, f))) AS i FROM (
            SELECT instance_id, count(*) FILTER (passed) AS p, count(*) FILTER (NOT passed) AS f
            FROM many_attempts GROUP BY instance_id) WHERE p > 0 AND f > 0) n
          JOIN (SELECT *, row_number() OVER (PARTITION BY instance_id, passed
              ORDER BY md5(attempt || '|' || patch)) - 1 AS place FROM many_attempts) a
            USING (instance_id)
          JOIN (SELECT *, row_number() OVER (PARTITION BY instance_id, passed
              ORDER BY md5(attempt || '|' || patch)) - 1 AS place FROM many_attempts) b
            USING (instance_id)
        WHERE a.passed AND NOT b.passed AND a.place = i % p AND b.place = i % f""",
)
TABLES["reconciled"] = (
    ["instances"],
    """
        WITH keys AS (
          SELECT doc_id, instance_id, patch, attempt,
            CASE WHEN (doc_id + attempt) % 4 = 0 THEN 0 WHEN (doc_id + attempt) % 3 = 0 THEN 2 ELSE 1 END AS n
          FROM instances, (SELECT unnest(range(4)) AS attempt)
        ), best AS (
          SELECT *, (SELECT min(pos) FROM (SELECT unnest([0, 1]) AS pos) WHERE pos < n AND (doc_id + pos) % 5 > 0) AS hit
          FROM keys
        )
        SELECT instance_id, CAST(attempt AS INTEGER) AS attempt,
          CASE WHEN attempt = 3 THEN 'unasked' WHEN n = 0 THEN 'lost' WHEN hit IS NULL THEN 'failed'
            ELSE 'answered' END AS state,
          CAST(least(n, 1) AS BIGINT) AS n_responses,
          CASE WHEN hit IS NOT NULL THEN 'answer ' || attempt || ' ' || hit || ' ' || patch
            WHEN n > 0 AND doc_id % 2 = 0 THEN '' END AS response
        FROM best WHERE attempt < 3 OR n > 0
        UNION ALL
        SELECT instance_id, CAST(attempt AS INTEGER), 'repeated', CAST(n - 1 AS BIGINT), NULL FROM best WHERE n > 1""",
)
STATEMENTS["matched_attempts"] = (["matched"], "SELECT * FROM matched")
STATEMENTS["pairs_pass_fail_all"] = (
    ["instances", "matched"],
    f"""SELECT {SFT_PROMPT} AS prompt, chosen, rejected, instance_id, 'pass_fail' AS strategy
        FROM matched JOIN instances USING (instance_id)""",
)
STATEMENTS["reconcile_responses"] = (["reconciled"], "SELECT * FROM reconciled")
STATEMENTS["pairs_from_answered"] = (
    ["instances", "reconciled"],
    f"""SELECT {SFT_PROMPT} AS prompt, patch AS chosen, rejected, instance_id, 'synthetic' AS strategy
        FROM (SELECT instance_id, trim(response, {text(WHITESPACE)}) AS rejected FROM reconciled
            WHERE state = 'answered') JOIN instances USING (instance_id)
        WHERE rejected <> patch""",
)
STATEMENTS["stage_counts"] = (
    ["instances", "results", "predictions", "rule_pairs"],
    f"""SELECT 'instances' AS stage, count(*) AS n_rows FROM instances
        UNION ALL SELECT 'results', count(*) FROM results
        UNION ALL SELECT 'predictions', count(*) FROM predictions
        UNION ALL SELECT 'rule_based pairs', count(*) FROM rule_pairs
        UNION ALL SELECT 'evaluation pairs', count(*) FROM ({_EVAL["all"]})
        UNION ALL SELECT 'pairs', count(*) FROM ({_EVAL["all"]} UNION ALL SELECT * FROM rule_pairs)""",
)
_LISTED = """(SELECT 1 FROM documents r WHERE r.doc_id % 7 = 3
          AND starts_with(instance_id, r.source || '__' || r.lang || '-' || r.doc_id))"""
STATEMENTS["filter_unsupported_in"] = (
    ["predictions"],
    f"SELECT instance_id, patch FROM predictions WHERE NOT EXISTS {_LISTED}",
)
STATEMENTS["only_unsupported_in"] = (
    ["predictions"],
    f"SELECT instance_id, patch FROM predictions WHERE EXISTS {_LISTED}",
)
STATEMENTS["unsupported_samples"] = (
    ["predictions"],
    f"""SELECT instance_id, greatest((SELECT count(*) FROM predictions WHERE {UNSUPPORTED}) - 5, 0) AS n_more
        FROM (SELECT instance_id FROM predictions WHERE {UNSUPPORTED} ORDER BY instance_id LIMIT 5)""",
)
STATEMENTS["metrics_per_repo_unmatched"] = (
    ["results", "instances"],
    """SELECT repo, count(*) AS total, count(*) FILTER (passed) AS resolved,
          CAST(count(*) FILTER (passed) / count(*) AS DOUBLE) AS resolve_rate
        FROM (SELECT coalesce(i.repo, replace(split_part(r.instance_id, '-', 1), '__', '/')) AS repo, passed
          FROM (SELECT instance_id, passed FROM results
              UNION ALL SELECT 'gone__' || (doc_id % 3) || '-' || doc_id, passed FROM results WHERE doc_id % 4 = 1) r
            LEFT JOIN instances i USING (instance_id))
        GROUP BY repo ORDER BY repo""",
)
_SIDES = ", ".join(
    f"{alias}.{name} AS {side}_{name}"
    for side, alias in (("base", "b"), ("tuned", "t"))
    for name in METRICS.names
)
STATEMENTS["cmp_document_full"] = (
    ["results", "results_base"],
    f"""SELECT {_SIDES}, t.resolved - b.resolved AS resolved_delta,
          t.resolve_rate - b.resolve_rate AS resolve_rate_delta
        FROM (SELECT {RATE_ROWS} FROM results) t, (SELECT {RATE_ROWS} FROM results_base) b""",
)
STATEMENTS["train_test_split_by_pair"] = (
    STATEMENTS["pairs_hybrid"][0],
    f"""SELECT instance_id, strategy, chosen, rejected,
          CASE WHEN n > 50 AND place <= ceil(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT *, count(*) OVER () AS n,
            row_number() OVER (ORDER BY md5('42|' || instance_id || '|' || strategy)) AS place
          FROM ({STATEMENTS["pairs_hybrid"][1]}))""",
)
TABLES["attempts"] = (
    ["predictions"],
    """
        SELECT instance_id, attempt, patch || attempt AS patch, (doc_id + attempt) % 3 = 0 AS passed
        FROM predictions, (SELECT unnest(range(3)) AS attempt)""",
)
STATEMENTS["read_written_examples"] = STATEMENTS["sft_format"]
STATEMENTS["read_patch_diffs"] = (
    ["predictions"],
    "SELECT instance_id || '/a+b %20' AS instance_id, patch FROM predictions WHERE patch <> ''",
)
STATEMENTS["lookup_in_stored"] = STATEMENTS["instance_lookup"]
STATEMENTS["examples_of_stored"] = STATEMENTS["sft_format"]
STATEMENTS["metrics_of_a_stream"] = STATEMENTS["metrics_global"]
STATEMENTS["read_written_pairs"] = (
    STATEMENTS["pairs_hybrid"][0],
    f"SELECT prompt, chosen, rejected, instance_id FROM ({STATEMENTS['pairs_hybrid'][1]})",
)
STATEMENTS["pairs_pass_fail"] = (["instances", "attempts"], STATEMENTS["pairs_pass_fail"][1])


def _with(names: list[str]) -> str:
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in TABLES[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return ""
    return "WITH " + ",\n".join(f"{name} AS ({TABLES[name][1]})" for name in ordered) + "\n"


def oracle_sql() -> dict[str, str]:
    return {name: _with(needs) + sql for name, (needs, sql) in STATEMENTS.items()}
