"""SQL for the queries that SQL can express. The others are tested against brute force:
op3 (permutation), op4 (checksums), op6 and op8 (tokens), op10 (model), and the pipeline, which has them."""

from __future__ import annotations

from patchloom.llm.secret_scan import CLASSES, KINDS, ONE_CASE, TERMS, WINDOW, CharacterClass
from patchloom.llm.sharding import SEED

_BLANK = r"[ \t\n\x0B\x0C\r]"

OP1 = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '{_BLANK}+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct([array_to_string(w[i:i + 2], ' ') FOR i IN range(1, len(w) - 1)]) END AS s
    FROM words
), shingles AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
pairs AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    GROUP BY ALL
), links AS (
    SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
    WHERE 100 * n >= 90 * (len(x.s) + len(y.s) - n)
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT doc_id, len(s) AS n_shingles, least_id AS component_id
FROM sets JOIN (SELECT doc_id, min(other) AS least_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_ASSIGN = (
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
    r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


def _kind(name: str, pattern: str, good: str) -> str:
    """Spans of one kind; ``good`` is a condition on the match m."""
    return f"""
    SELECT row_id, s AS start, s + length(m) AS stop, '{name}' AS kind, {KINDS.index(name)} AS place FROM (
        SELECT row_id, m, sum(length(gap) + CASE WHEN k > 1 THEN length(before) ELSE 0 END)
            OVER (PARTITION BY row_id ORDER BY k) AS s
        FROM (
            SELECT row_id, unnest(range(1, len(ms) + 1)) AS k, unnest(ms) AS m,
                unnest(gaps[1:len(ms)]) AS gap, unnest(list_concat([''], ms[1:len(ms) - 1])) AS before
            FROM (SELECT row_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gaps
                  FROM texts) WHERE len(ms) > 0
        )
    ) WHERE {good}"""


def _entropy(c: CharacterClass) -> str:
    """Runs that hold a candidate: a stretch between allowed words with what the class needs
    and a window of enough entropy."""
    needs = " AND ".join(f"regexp_matches(p, '{n}')" for n in c.needs)
    window = (
        f"list_sum([({TERMS})[(n + 1)::BIGINT] FOR n IN map_values(list_histogram(string_split(substr(p, i, {WINDOW}), '')))])"
    )
    best = f"list_min([{window} FOR i IN range(1, length(p) - {WINDOW} + 2)])"
    stretches = f"string_split_regex(m, '{c.allowed}')"
    good = f"len([p FOR p IN {stretches} IF CASE WHEN length(p) >= {WINDOW} AND {needs} THEN {best} <= {c.most} ELSE false END]) > 0"
    return _kind(c.kind, c.pattern, good)


OP2 = f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row_id, coalesce(text, '') AS t FROM documents),
wide AS (
    {_kind("assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
    UNION ALL {_kind("access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
    UNION ALL {_kind("hex", "[0-9a-f]+", "length(m) >= 24")}
    UNION ALL {" UNION ALL ".join(_entropy(c) for c in CLASSES)}
), own AS (
    {" UNION ALL ".join(_entropy(c) for c in ONE_CASE)}
), spans AS (
    SELECT * FROM wide
    UNION ALL SELECT * FROM own WHERE NOT EXISTS (
        SELECT 1 FROM wide WHERE wide.row_id = own.row_id AND wide.start <= own.start AND wide.stop >= own.stop)
)
SELECT doc_id,
    count(*) FILTER (kind = 'assign') AS n_assign,
    count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex,
    sha256(coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place)
        FILTER (place < 3), '')) AS base_sha256,
    coalesce(string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, place)
        FILTER (place IS NOT NULL), '') AS spans
FROM texts LEFT JOIN spans USING (row_id) GROUP BY row_id, doc_id
"""

#: op4 without text_crc32, which SQL has no function for; a test compares the rest.
OP4_PLACES = f"""
WITH known AS (
    SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, text,
        md5(CASE WHEN source IS NULL THEN '0' ELSE '1' || source END) AS src,
        md5('{SEED}|' || coalesce(doc_id::VARCHAR, '')) AS mixed
    FROM documents
), ranked AS (
    SELECT *, (row_number() OVER (PARTITION BY src ORDER BY mixed, doc_id, size) - 1
        + ('0x' || left(src, 8))::BIGINT / 4294967296.0::DOUBLE) / count(*) OVER (PARTITION BY src) AS f
    FROM known
), placed AS (
    SELECT *, row_number() OVER (ORDER BY f, src, mixed, doc_id, size) - 1 AS place, count(*) OVER () AS total
    FROM ranked
)
SELECT doc_id, size, 'rows' AS law, (place * 8 // total)::INT AS shard,
    place - ((place * 8 // total) * total + 7) // 8 AS slot, NULL::INT AS grown_shard
FROM placed
"""

OP7 = """
WITH RECURSIVE good AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.9
), reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
    min(other) AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
"""

OP9 = f"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
    FROM documents
), keyed AS (
    SELECT *, translate(regexp_replace(regexp_replace(line, '^{_BLANK}+', ''), '{_BLANK}+$', ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), often AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT doc_id, line, place, keeper IS NOT NULL AND doc_id <> keeper AS gone FROM keyed LEFT JOIN often USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP11 = """
WITH good AS (
    SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, a.label = r.label AS same, r.vec_id,
        list_inner_product(a.v, r.v)::BIGINT AS score
    FROM good a JOIN good r ON a.vec_id <> r.vec_id AND len(a.v) = len(r.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
    n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 80::HUGEINT * positive_score <= 100::HUGEINT * n.score AND n.score <= positive_score
QUALIFY rank <= 5
"""


def _repair_step() -> str:
    """Four best (cost, edits, text) records, one for each state, from those before a turn.

    States are 1 nothing, 2 system, 3 user, 4 assistant; x is the turn."""
    due = {1: 3, 2: 3, 3: 4, 4: 3}
    role = {3: "user", 4: "assistant"}
    into: dict[int, list[str]] = {s: [] for s in due}
    for start in due:
        state, cost, edits, text = start, 0, "", f"y.s[{start}].o"
        for _ in range(3):
            before = f"y.s[{start}].c + {cost}"
            edit = f"y.s[{start}].a || '{edits}%s'"
            record = "{{'c': {}, 'a': {}, 'o': {}}}".format
            into[state].append(record(f"{before} + 3", edit % "D", text))
            kept = {("s", 1): 2, ("u", 1): 3, ("u", 2): 3, ("u", 4): 3, ("a", 3): 4}
            for (initial, at), then in kept.items():
                if at == state:
                    fits = f"CASE WHEN x.i = '{initial}' AND NOT x.gone THEN {before} + x.t ELSE 1000000000 END"
                    into[then].append(record(fits, edit % "K", f"{text} || x.role || ':' || x.text || chr(10)"))
            then = due[state]
            fits = f"CASE WHEN NOT x.gone THEN {before} + 2 + x.t ELSE 1000000000 END"
            into[then].append(record(fits, edit % "R", f"{text} || '{role[then]}:' || x.text || chr(10)"))
            state, cost, edits, text = then, cost + 2, edits + "I", f"{text} || '{role[then]}:' || chr(10)"
    return ", ".join(f"list_min([{', '.join(records)}])" for records in into.values())


_RECORD = "STRUCT(c BIGINT, a VARCHAR, o VARCHAR)"
OP12 = f"""
WITH named AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
    FROM conversations
), coded AS (
    SELECT *, xor(list_reduce(
        flatten([[ord(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[] FOR c IN string_split(name, '')]),
        lambda y, x: CASE WHEN x >= 0 THEN xor(y, x)
            ELSE xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END) END,
        4294967295::BIGINT), 4294967295::BIGINT) % 20 AS kind
    FROM named
), damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
    FROM coded WHERE kind <> 0
), placed AS (
    SELECT *, coalesce('=' || conv_id, '') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(concat_ws(':', length(coalesce('=' || conv_id, '')), coalesce('=' || conv_id, ''), length(role), role, text))) AS place
    FROM damaged
), seen AS (
    SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS cut,
        left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before
    FROM placed
), listed AS (
    SELECT conv_id,
        coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank,
        count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
        count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal,
        list({{'s': NULL::{_RECORD}[], 'gone': blank OR again, 'i': i, 't': cut::INT, 'role': role, 'text': text}}
            ORDER BY place) AS rows
    FROM seen GROUP BY conv_id
), solved AS (
    SELECT * EXCLUDE rows, list_reduce(rows,
        lambda y, x: {{'s': [{_repair_step()}], 'gone': false, 'i': '', 't': 0, 'role': '', 'text': ''}},
        {{'s': [{{'c': 0, 'a': '', 'o': ''}}, {{'c': 100000000, 'a': '', 'o': ''}}, {{'c': 100000000, 'a': '', 'o': ''}},
            {{'c': 100000000, 'a': '', 'o': ''}}]::{_RECORD}[], 'gone': false, 'i': '', 't': 0, 'role': '', 'text': ''}}).s AS s
    FROM listed
), ended AS (
    SELECT * EXCLUDE s, list_min([s[1], s[4],
        {{'c': s[2].c + 4, 'a': s[2].a || 'II', 'o': s[2].o || 'user:' || chr(10) || 'assistant:' || chr(10)}},
        {{'c': s[3].c + 2, 'a': s[3].a || 'I', 'o': s[3].o || 'assistant:' || chr(10)}}]) AS best
    FROM solved
)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
    coalesce(best.a, '') AS audit, sha256(coalesce(left(best.o, -1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) ids LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": OP1,
        "op2_secret_scans": OP2,
        "op7_embedding_near_dedup": OP7,
        "op9_line_dedup": OP9,
        "op11_hard_negatives": OP11,
        "op12_conversation_repair": OP12,
    }
