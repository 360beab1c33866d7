"""DuckDB SQL with the same results as the named queries, written against the same tables.

Adapters that a text names are put in front as common table expressions by ``oracle_sql``.
"""

from __future__ import annotations

from ..functions.text import CREDENTIAL, EPISODIC, NEGATION_CUES, PROCEDURAL, SEMANTIC
from ..operators.entity_documents import ENTITIES, pieces
from ..operators.mappings import CAP, CAPS, IMPORTANCE, IMPORTANCES, MAPPINGS
from ..operators.ontology import FAMILIES
from ..sources.adapters import BUSINESS_COLUMNS, with_adapters

_CUES = tuple(c.replace("'", "''") for c in NEGATION_CUES)
_LIVE = "tier = 'hot' and invalid_at is null"
_OPEN = "valid_to is null"


def _in(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def _merged(new: str) -> str:
    """metadata with the entries of ``new``: of an object the last value of each key in the place of its first, others in a list."""
    entries = f"""(select string_agg(to_json(key) || ':' || value, ',' order by first) from (select key, arg_max(cast(value as varchar), n) as value, min(n) as first from (
        select key, value, id as n from json_each(try_cast({{0}} as json))) where not list_contains(json_keys({new}), key) group by key))"""
    add = f"substring(cast({new} as varchar), 2)"
    return f"""case when metadata is null then cast({new} as varchar) when not json_valid(metadata) then '{{"unparsed":' || to_json(metadata) || ',' || {add}
        when json_type(metadata) = 'OBJECT' then '{{' || {entries.format("metadata")} || ',' || {add} else substring(metadata, 1, length(metadata) - 1) || ',' || {new} || ']' end"""


def _cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::double[], {b}::double[])"


_QUERY = "(select embedding from embeddings where vec_id = 0)"
_WEEK = "cast(date_trunc('week', {}) as date)"


def _week(c: str) -> str:
    return _WEEK.format(c)


def _label(c: str) -> str:
    return f"strftime({c}, '%G-W%V')"


def _big(c: str) -> str:
    return f"cast({c} as bigint)"


_VECTOR = """vec as (
  select id, rank, distance from (
    select id, round(1 - {cos}, 6) as distance, row_number() over (order by round(1 - {cos}, 6), id) as rank
    from memories where {where} and embedding is not null) where rank <= {k})"""

_TERMS = ("disgusting", "thing", "trash")


def _vector(k: int, where: str = _LIVE) -> str:
    return _VECTOR.format(cos=_cosine("embedding", _QUERY), where=where, k=k)


def _bm25(k: int, where: str = _LIVE) -> str:
    tf = ", ".join(f"len(list_filter(words, lambda w: w = '{t}')) as tf{i}" for i, t in enumerate(_TERMS))
    df = ", ".join(f"count(*) filter (tf{i} > 0) as df{i}" for i in range(len(_TERMS)))
    some = " or ".join(f"tf{i} > 0" for i in range(len(_TERMS)))
    score = " + ".join(
        f"ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (1 - 0.75 + 0.75 * length / mean))" for i in range(len(_TERMS))
    )
    return f"""words as (select id, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') as words from memories where {where}),
    counted as (select id, len(words) as length, {tf} from words),
    corpus as (select count(*) as n, avg(length) as mean, {df} from counted),
    scored as (select id, round({score}, 6) as score from counted, corpus where {some}),
    txt as (select id, score, rank from (select id, score, row_number() over (order by score desc, id) as rank from scored) where rank <= {k})"""


def _fused(k: int, where: str = _LIVE, floor: str = "", limit: int = 8) -> str:
    return f"""{_vector(k, where)}, {_bm25(k, where)},
    both_ranks as (select coalesce(v.id, t.id) as id, v.rank as rv, t.rank as rt from vec v full join txt t on v.id = t.id),
    fused as (
      select m.id, m.namespace, m.content, m.importance, m.valid_at,
             round(coalesce(1.0 / (60 + rv), 0) + coalesce(1.0 / (60 + rt), 0) + 0.01 * m.importance, 6) as score
      from both_ranks b join memories m on m.id = b.id {floor} order by score desc, id limit {limit})"""


def _recall(where: str, scope: str, floor: str = "", limit: int = 8, window: str = "true", order: str = "first", live: str = _LIVE) -> str:
    """A recall with expansion: the fused rows, then neighbours among all live rows of the scope, cut to the window after they are chosen."""
    return f"""with {_fused(40, f"{live} and {where}", floor, limit)},
    seeds as (select id, score, valid_at, importance, row_number() over (order by score desc, id) as first from fused),
    via as (select n.memory_id as id, min(e.name) as via_entity from memory_entities s join memory_entities n on n.entity_id = s.entity_id join entities e on e.id = s.entity_id
      where s.memory_id in (select id from seeds) and n.memory_id not in (select id from seeds) group by 1),
    extra as (select m.id, round(0.05 + 0.15 * m.importance, 6) as score, m.valid_at, m.importance, via_entity from memories m join via v on v.id = m.id
      where {_LIVE} and {scope} order by score desc, m.id limit {max(2, limit // 2)}),
    both_parts as (select id, score, valid_at, importance, cast(null as varchar) as via_entity, first from seeds
      union all select id, score, valid_at, importance, via_entity, {limit} + row_number() over (order by score desc, id) from extra where {window})
    select cast(row_number() over (order by {order}) as integer) as place, id, score, valid_at, importance, via_entity from both_parts"""


_ENDS = f"""with t as (select relation, s.entity_type as src, d.entity_type as dst from entity_edges join entities s on s.id = src_id join entities d on d.id = dst_id where {_OPEN}),
    e as (select relation, 'src' as side, src as type, count(*) as n from t group by all union all select relation, 'dst', dst, count(*) from t group by all),
    o as (select relation, side, cast(sum(n) as bigint) as edges, case when max(n) / sum(n) >= 0.95 then arg_max(type, n) else string_agg(type, '|' order by n desc, type) end as types
      from e group by 1, 2)
    select relation, max(edges) as edges, max(types) filter (side = 'src') as src_types, max(types) filter (side = 'dst') as dst_types from o group by 1"""
_SAID = r"""m as (select *, coalesce(nullif(domain_raw, ''), 'item') as type, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as k from memories where namespace = 'en' and invalid_at is null),
    ventures_said as (select distinct concat('V', k % 25) as venture, case when k % 3 > 0 then concat('P', k % 5) else 'unassigned' end as portfolio from m where type = 'venture'),
    rest as (select id, type, k, valid_at, metadata, concat(case when k % 4 = 0 then concat('Noted in venture V', k % 25, ': ') else '' end, content) as content from m where type <> 'venture'),
    linked as (select * from (select id, type, trim(regexp_extract(content, ' in venture ([^:.\n]+)', 1)) as venture, substring(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 44) as name
      from rest where contains(content, 'in venture ') order by valid_at desc, id limit 200) where venture in (select venture from ventures_said)),
    kinds as (select type, count(*) as n from rest group by 1 order by n desc, type limit 30),
    few as (select id, type, substring(trim(regexp_replace(coalesce(nullif(json_extract_string(try_cast(metadata as json), '$.slug'), ''), content), '\s+', ' ', 'g')), 1, 44) as name from (
      select *, row_number() over (partition by type order by valid_at desc, id) as r from rest) where r <= 20 and type in (select type from kinds))"""


def _families(relations) -> str:
    parts = []
    for relation in relations:
        for table, src, dst, kind in FAMILIES[relation]:
            ref = f"concat('db:{kind}:', id)" if kind else "cast(null as varchar)"
            parts.append(f"select {src} as src, {dst} as dst, '{relation}' as relation, {ref} as ref from {table} where {src} is not null and {dst} is not null")
    return " union all ".join(parts)


_CLASSES = f"""case when k in ({_in(SEMANTIC)}) then 'semantic' when k in ({_in(PROCEDURAL)}) then 'procedural'
  when k in ({_in(EPISODIC)}) then 'episodic' end"""

_STEPS = "steps as (select src_id x, dst_id y, relation, valid_from from entity_edges where {w} union all select dst_id, src_id, relation, valid_from from entity_edges where {w})"


def _walk(name: str, depth: int, where: str = _OPEN, direction: str = "both", types: str = "", limit: int = 100) -> str:
    out = f"select src_id x, dst_id y from entity_edges where {where}"
    back = f"select dst_id x, src_id y from entity_edges where {where}"
    steps = {"out": out, "in": back, "both": f"{out} union all {back}"}[direction]
    return f"""with recursive steps as ({steps}),
    walk(id, depth) as (
      select id, 0 from entities where name = '{name}'
      union select y, depth + 1 from walk join steps on x = id where depth < {depth})
    select name, entity_type, depth, round(1.0 / (1 + depth), 6) as distance
    from (select id, cast(min(depth) as integer) as depth from walk group by id) w join entities e using (id)
    where depth > 0 {types} order by depth, name limit {limit}"""


def _propagation(rounds: int) -> str:
    parts = [
        f"""adjacency as (select x, y, count(*) as weight from (select src_id x, dst_id y from entity_edges where {_OPEN}
        union all select dst_id, src_id from entity_edges where {_OPEN}) group by x, y)""",
        "l0 as (select id, id as label from entities)",
    ]
    for i in range(rounds):
        parts.append(
            f"""l{i + 1} as materialized (select l.id, coalesce(w.label, l.label) as label from l{i} l left join (
          select id, label from (select x as id, label, row_number() over (partition by x order by sum(weight) desc, label) as r
            from adjacency join l{i} n on n.id = y group by x, label) where r = 1) w on w.id = l.id)"""
        )
    return "with " + ",\n".join(parts)


def _list(label: str, value: str) -> str:
    return f"string_agg(concat({label}, ' (', cast({value} as varchar), ')'), ', ' order by {value} desc, {label})"


_LAST16 = f"(select {_week('max({c})')} - 105 from {{t}})"
_PERSON = "coalesce(p.person, c.author_login)"
_COMMITS16 = f"""recent as (select c.*, {_week('c.day')} as week, {_PERSON} as person from github_commits c
  left join people p on p.login = c.author_login
  where {_week('c.day')} >= (select {_week('max(day)')} - 105 from github_commits))"""
_CLAUDE16 = f"""recent as (select *, {_week('created_at')} as week from claude_activity_events
  where {_week('created_at')} >= (select {_week('max(created_at)')} - 105 from claude_activity_events))"""
_COST = "round((sum(input_tokens) * 3.0 + sum(output_tokens) * 15.0 + sum(cache_read_tokens) * 0.3 + sum(cache_creation_tokens) * 3.75) / 1e6, 4)"
_MINUTES = "date_diff('minute', {}, {})"


def _root(text: str) -> str:
    return f"""(select id from entities where name = '{text}' or lower(name) = lower('{text}') or id = '{text}'
        order by coalesce(name = '{text}', false) desc, id = '{text}' desc, length(name), id limit 1)"""


def _spine(where: str, hubs: str, per_group: int, text: str = "nation_7") -> str:
    return f"""with recursive {_STEPS.format(w=_OPEN)},
    walk(id, path, depth, relation, since) as (
      select id, [id], 0, cast(null as varchar), cast(null as timestamp) from {_root(text)}
      union all
      select y, list_append(path, y), depth + 1, s.relation, s.valid_from from walk w join steps s on s.x = w.id
      join entities e on e.id = w.id
      where depth < 2 and not list_contains(path, y) and (depth = 0 or e.entity_type in ({hubs}))),
    best as (
      select w.id, e.name, e.entity_type as role, w.depth, w.relation,
             row_number() over (partition by w.id order by w.depth, w.since desc nulls last, w.relation) as r
      from walk w join entities e on e.id = w.id where w.depth > 0 and {where}),
    ranked as (select *, count(*) over (partition by role) as total, row_number() over (partition by role order by depth, name) as rank
      from best where r = 1)
    select role, total, cast(rank as integer) as rank, name, cast(depth as integer) as depth, relation from ranked where rank <= {per_group}"""


def _html() -> str:
    out = r"regexp_replace(substring(coalesce(html, ''), 1, 4194304), '(?is)<(?:script|style|noscript)[^>]*>.*?</\s*(?:script|style|noscript)\s*>', ' ', 'g')"
    for tag, lines in (("<br>", 1), ("<br/>", 1), ("<br />", 1), ("</p>", 2), ("</div>", 1), ("</li>", 1), ("</h1>", 2), ("</h2>", 2), ("</h3>", 2)):
        out = f"replace({out}, '{tag}', repeat(chr(10), {lines}))"
    out = _decoded(f"regexp_replace({out}, '(?s)<[^>]+>', '', 'g')")
    out = rf"regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({out}, '^\s+|\s+$', '', 'g')"


def _decoded(c: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("nbsp", " "), ("mdash", "—"), ("rsquo", "''"), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{char}')"
    return c


_HTML = _html()
_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"


SQL: dict[str, str] = {
    "v_feature_daily": """select cast(created_at as date) as day, feature_key, event, count(*) as events, count(distinct user_id) as users,
        count(distinct session_id) as sessions, cast(sum(engagement_ms) as bigint) / 1000.0::double as engagement_s from feature_events group by all""",
    "v_dau": """select day, count(distinct user_id) as users, cast(sum(events) as bigint) as events from (
        select cast(created_at as date) as day, user_id, count(*) as events from feature_events group by all
        union all select cast(created_at as date), user_id, count(*) from transition_events group by all) group by day""",
    "v_wau": f"""select {_week('created_at')} as week, count(distinct user_id) as users from (
        select created_at, user_id from feature_events union all select created_at, user_id from transition_events) group by 1""",
    "v_feature_adoption_weekly": f"""select {_week('created_at')} as week, feature_key, count(*) as events, count(distinct user_id) as users
        from feature_events group by all""",
    "v_user_activity": """select f.user_id, any_value(u.display_name) as display_name, any_value(u.team) as team, count(*) as events,
        count(distinct cast(f.created_at as date)) as active_days, min(f.created_at) as first_seen, max(f.created_at) as last_seen
        from feature_events f left join dim_users u on u.id = f.user_id group by f.user_id""",
    "v_top_paths": """select path, count(*) as events, count(distinct user_id) as users, count(distinct session_id) as sessions
        from feature_events where path is not null group by path""",
    "v_venture_activity_daily": """select cast(a.created_at as date) as day, a.venture_id, v.name as venture, source, count(*) as events from (
        select created_at, venture_id, 'feature' as source from feature_events union all select created_at, venture_id, 'agent' from agent_actions) a
        left join dim_ventures v on v.id = a.venture_id group by all""",
    "v_venture_totals": """select v.id as venture_id, v.name, coalesce(f.n, 0) as feature_events, coalesce(a.n, 0) as agent_actions,
        greatest(coalesce(f.last, timestamp '1970-01-01'), coalesce(a.last, timestamp '1970-01-01')) as last_seen
        from dim_ventures v left join (select venture_id, count(*) n, max(created_at) as last from feature_events group by 1) f on f.venture_id = v.id
        left join (select venture_id, count(*) n, max(created_at) as last from agent_actions group by 1) a on a.venture_id = v.id""",
    "v_commits_repo_weekly": f"""select {_week('day')} as week, org_slug, repo_full_name, count(*) as commits, count(distinct author_login) as authors,
        {_big('sum(additions)')} as additions, {_big('sum(deletions)')} as deletions from github_commits group by all""",
    "v_commits_author_daily": f"""select day, author_login, count(*) as commits, count(distinct repo_full_name) as repos,
        {_big('sum(additions)')} as additions, {_big('sum(deletions)')} as deletions from github_commits group by all""",
    "v_commit_hour_heatmap": "select cast(dayofweek(day) as integer) as dow, cast(commit_hour as integer) as hour, count(*) as commits from github_commits group by all",
    "v_pr_throughput_weekly": f"""select {_week('created_at')} as week, repo_full_name, count(*) as opened, count(merged_at) as merged,
        count(first_review_at) as reviewed, median({_MINUTES.format('created_at', 'first_review_at')}) as median_review_minutes,
        median({_MINUTES.format('created_at', 'merged_at')}) as median_merge_minutes from github_pull_requests group by all""",
    "v_claude_daily": f"""select cast(created_at as date) as day, actor_kind, event_type, count(*) as events,
        count(distinct coalesce(cast(user_id as varchar), agent_id)) as actors, count(distinct session_id) as sessions,
        {_big('sum(input_tokens)')} as input_tokens, {_big('sum(output_tokens)')} as output_tokens, {_big('sum(total_tokens)')} as total_tokens
        from claude_activity_events group by all""",
    "v_claude_by_actor": f"""select actor_kind, coalesce(u.display_name, c.agent_id) as actor, count(*) as events, count(distinct session_id) as sessions,
        count(distinct cast(created_at as date)) as active_days, {_big('sum(total_tokens)')} as total_tokens
        from claude_activity_events c left join dim_users u on u.id = c.user_id group by all""",
    "v_claude_sessions": f"""select session_id, min(created_at) as started, max(created_at) as ended, count(*) as events,
        {_big('sum(total_tokens)')} as total_tokens, min(cwd) as cwd, {_MINUTES.format('min(created_at)', 'max(created_at)')} as duration_min
        from claude_activity_events group by session_id""",
    "v_agent_actions_daily": """select cast(a.created_at as date) as day, a.agent_id, a.trigger_kind, a.kind, v.name as venture, count(*) as actions
        from agent_actions a left join dim_ventures v on v.id = a.venture_id group by 1, 2, 3, 4, 5, a.venture_id""",
    "v_issue_activity_daily": """select cast(created_at as date) as day, action, actor_kind, count(*) as events, count(distinct issue_id) as issues
        from issue_activity group by all""",
    "v_notifications_daily": """select cast(created_at as date) as day, kind, count(*) as sent, count(read_at) as read,
        round(100.0::double * count(read_at) / nullif(count(*), 0), 1) as read_pct from notifications group by all""",
    "top_repos_30d": """select repo_full_name, count(*) as commits from github_commits where day > (select max(day) from github_commits) - 30
        group by 1 order by commits desc, repo_full_name limit 5""",
    "dau_last_14d": """select day, count(distinct user_id) as users, cast(sum(events) as bigint) as events from (
        select cast(created_at as date) as day, user_id, count(*) as events from feature_events group by all
        union all select cast(created_at as date), user_id, count(*) from transition_events group by all) group by day order by day desc limit 14""",
    "feature_this_vs_earlier": """select feature_key, count(*) filter (late) as this_period, count(*) filter (not late) as earlier from (
        select feature_key, cast(created_at as date) > (select cast(max(created_at) as date) from feature_events) - 14 as late from feature_events) group by 1""",
    "tokens_per_day": f"select cast(created_at as date) as day, {_big('sum(total_tokens)')} as tokens, count(*) as events from claude_activity_events group by 1",
    "top_ventures": """select v.name, coalesce(f.n, 0) + coalesce(a.n, 0) as activity from dim_ventures v
        left join (select venture_id, count(*) n from feature_events group by 1) f on f.venture_id = v.id
        left join (select venture_id, count(*) n from agent_actions group by 1) a on a.venture_id = v.id order by activity desc, name limit 10""",
    "live_memories": f"select id, namespace, importance, valid_at from memories where {_LIVE} and namespace in ('en', 'fr')",
    "recall_filters_types": f"select id, domain_raw from memories where {_LIVE} and coalesce(nullif(domain_raw, ''), 'item') in ('post', 'item')",
    "recall_exclude_kinds": f"select id, source_kind from memories where {_LIVE} and coalesce(source_kind, '') not in ('src1', 'src7')",
    "recall_since_until": f"select id, valid_at from memories where {_LIVE} and valid_at between timestamp '2024-01-05' and timestamp '2024-01-20'",
    "recall_as_of": """select id, valid_at, invalid_at from memories where tier = 'hot' and valid_at <= timestamp '2024-01-20'
        and (invalid_at is null or invalid_at > timestamp '2024-01-20')""",
    "dedup_source_ref": f"""select id, namespace, source_ref, kept_id from (select *, first_value(id) over (partition by namespace, source_ref order by valid_at desc, id desc) as kept_id
        from memories where {_LIVE}) where id <> kept_id""",
    "dedup_forget_metadata": f"""with m as (select *, first_value(id) over (partition by namespace, source_ref order by valid_at desc, id desc) as kept_id from memories where {_LIVE})
        select id, {_merged("json_object('forget_reason', 'duplicate', 'superseded_by', kept_id)")} as metadata from m where id <> kept_id""",
    "dedup_source_kind": f"""with rows as (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) % 4 as k from memories where {_LIVE}),
        own_posts as (select id, namespace, valid_at, concat('ref:', length(content)) as ref, k from rows where k < 3)
        select id, kept_id from (select id, first_value(id) over (partition by namespace, ref order by valid_at desc, id desc) as kept_id from own_posts where k = 2) where id <> kept_id""",
    "classify_prefixed": """select concat(doc_id, '')::bigint as id, kind, case when kind in ('venture', 'doc') then 'semantic' when kind = 'playbook' then 'procedural' else 'episodic' end as memory_type
        from (select doc_id, case doc_id % 7 when 0 then 'post' when 1 then 'photos_post' when 2 then 'venture' when 3 then 'playbook' when 4 then 'doc' when 5 then 'apps_doc'
          else 'videos_doc' end as kind from documents)""",
    "classify_memory": f"""select id, domain_type, memory_type, case when memory_type in ('semantic', 'procedural') then 'fact' else 'experience' end as network from (
        select id, domain_type, coalesce((select {_CLASSES} from (select domain_type as k)), (select {_CLASSES} from (select source_kind as k)), 'episodic') as memory_type
        from (select id, coalesce(nullif(domain_raw, ''), 'item') as domain_type, source_kind from memories))""",
    "norm_text": f"select doc_id, sha256({_NORM.format('text')}) as norm_sha, cast(length({_NORM.format('text')}) as integer) as norm_chars from documents",
    "negation_cues": "select doc_id, " + " or ".join(f"contains(lower(t), '{c}')" for c in _CUES)
    + " as negates from (select doc_id, case when doc_id % 9 = 0 then 'That Was WRONG. ' || text else text end as t from documents)",
    "brain_stats": f"""select * from (select count(distinct namespace) filter (invalid_at is null) as namespaces, count(*) filter (invalid_at is null) as memories,
          count(distinct owner_agent_id) as agents,
          count(distinct source_ref) filter (valid_at > timestamp '2024-01-14 12:00:00' and valid_at <= timestamp '2024-01-15 12:00:00') as sessions_24h from memories),
        (select count(*) as entities from entities), (select count(*) as links from memory_entities),
        (select count(*) as recalls_24h from memory_events where op = 'recall' and ts > timestamp '2024-01-14 12:00:00' and ts <= timestamp '2024-01-15 12:00:00'),
        (select count(*) as open_gaps from (select distinct namespace, {_NORM.format('query')} as q from memory_events where op in ('recall', 'search') and outcome = 'empty')
          where q not in ('q3', 'q7'))""",
    "namespaces": "select namespace, count(*) as memories, max(valid_at) as last_activity from memories where invalid_at is null group by 1",
    "brain_detail_types": """select coalesce(nullif(domain_raw, ''), 'item') as type, count(*) as memories from memories
        where invalid_at is null and namespace = 'en' group by 1""",
    "brain_detail_sources": "select coalesce(source_kind, '') as source, count(*) as memories from memories where invalid_at is null and namespace = 'en' group by 1",
    "brain_detail": """select * from (select count(*) as memories, min(valid_at) as first, max(valid_at) as last from memories where namespace = 'en' and invalid_at is null),
        (select count(distinct query) filter (op in ('recall', 'search') and outcome = 'empty') as open_gaps, count(*) filter (op = 'recall') as recalls
         from memory_events where namespace = 'en')""",
    "activity_log": """select id, ts, namespace, op, agent_id, latency_ms from memory_events where namespace = 'en' and op = 'recall'
        order by ts desc, id desc limit 50""",
    "gap_upsert": f"""select namespace, substring({_NORM.format('query')}, 1, 2000) as query, count(*) as hits, min(ts) as first_seen, max(ts) as last_seen
        from memory_events where op in ('recall', 'search') and outcome = 'empty' group by 1, 2""",
    "gaps_ranked": f"""select namespace, query, hits, last_seen, case when query in ('q3', 'q7') then 'resolved' else 'open' end as status from (
        select namespace, substring({_NORM.format('query')}, 1, 2000) as query, count(*) as hits, max(ts) as last_seen
        from memory_events where op in ('recall', 'search') and outcome = 'empty' group by 1, 2)
        order by status = 'open' desc, hits desc, last_seen desc, namespace, query limit 60""",
    "acl_readable_memories": "select id, namespace from memories where namespace in (select namespace from grants where agent_id = 'a1' and can_read)",
    "write_decision": f"""with live as (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as k from memories where {_LIVE} and embedding is not null),
        batch as (select 'new-' || id as id, namespace, case k % 3 when 0 then content when 1 then 'Correction: ' || content else content || ' more' end as content,
          list_transform(embedding::double[], lambda x, i: x + case when i = 1 then (case k % 3 when 1 then 0.3 when 2 then 0.02 else 0 end)::double else 0 end) as embedding
          from live where k % 50 = 0),
        scored as (select b.id, b.content, m.id as top_id, m.content as top_content, round({_cosine('b.embedding', 'm.embedding')}, 6) as similarity
          from batch b join live m on m.namespace = b.namespace),
        best as (select * from (select *, row_number() over (partition by id order by similarity desc, top_id) as r from scored) where r = 1)
        select id, top_id, similarity, case when {_NORM.format('content')} = {_NORM.format('top_content')} then 'noop'
          when similarity >= 0.88 and ({" or ".join(f"contains(lower(content), '{c}')" for c in _CUES)}) then 'invalidate'
          when similarity >= 0.97 then 'noop' when similarity >= 0.88 then 'update' else 'add' end as decision from best""",
    "apply_writes_current_state": """select namespace, source_ref, arg_max(id, (valid_at, id)) as current_id, max(valid_at) as valid_at, count(*) as versions
        from memories group by 1, 2""",
    "access_stats": """select namespace, agent_id, count(*) as access_count, max(ts) as last_accessed_at,
        round(least(1.0::double, 0.5 + 0.02::double * count(*)), 6) as importance from memory_events where op in ('recall', 'search') group by 1, 2""",
    "ann_topk": f"with {_vector(40)} select id, distance, cast(rank as integer) as rank from vec",
    "nearest_neighbor_pairs": f"""select vec_id, neighbor, similarity from (
        select a.vec_id, b.vec_id as neighbor, round({_cosine('a.embedding', 'b.embedding')}, 6) as similarity,
          row_number() over (partition by a.vec_id order by round({_cosine('a.embedding', 'b.embedding')}, 6) desc, b.vec_id) as r
        from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0) where r = 1""",
    "bm25_topk": f"with {_bm25(40)} select id, score, cast(rank as integer) as rank from txt",
    "bm25_indexed": f"with {_bm25(40)} select id, score, cast(rank as integer) as rank from txt",
    "recall_full": _recall("namespace = 'en'", "namespace = 'en'", order="valid_at desc, first"),
    "recall_full_window": _recall(
        "namespace in ('en', 'de') and coalesce(nullif(domain_raw, ''), 'item') in ('post', 'doc', 'item') and source_kind <> 'src1'"
        " and valid_at between timestamp '2024-01-03' and timestamp '2024-01-20'",
        "namespace in ('en', 'de')", floor="and m.importance >= 0.2::double", limit=6, window="valid_at between timestamp '2024-01-03' and timestamp '2024-01-20'",
    ),
    "recall_full_as_of": _recall(
        "tier = 'hot' and valid_at <= timestamp '2024-01-20' and (invalid_at is null or invalid_at > timestamp '2024-01-20')", "true", limit=10,
        window="valid_at <= timestamp '2024-01-20'", order="valid_at, first", live="true",
    ),
    "recall_hybrid_rrf": f"with {_fused(40)} select id, score from fused",
    "recall_vector_fallback": f"""with {_vector(40)} select v.id, cast(v.rank as integer) as rank, v.distance, round((1 - v.distance) + 0.15 * m.importance, 6) as score
        from vec v join memories m on m.id = v.id""",
    "search_cross_brain": f"with {_fused(60, _LIVE + " and namespace in ('en', 'de', 'es')", limit=12)} select id, namespace, score from fused",
    "recall_min_importance": f"with {_fused(40, floor='where m.importance >= 0.5', limit=40)} select id, importance, score from fused",
    "recall_order_recent": f"with {_fused(40)} select id, valid_at from fused",
    "recall_rerank": f"""with {_fused(40, limit=40)}, pool as (select *, row_number() over (order by score desc, id) as before,
          round(len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+')), ['disgusting', 'thing', 'trash'])) / 3.0, 6) as again from fused)
        select id, cast(again as double) as score from pool order by again desc, before limit 8""",
    "expand_entities": f"""with {_fused(40)}, ents as (select distinct entity_id from memory_entities where memory_id in (select id from fused)),
        via as (select me.memory_id as id, min(e.name) as via_entity from memory_entities me join ents using (entity_id) join entities e on e.id = me.entity_id
          where me.memory_id not in (select id from fused) group by 1)
        select m.id, via_entity, round(0.05 + 0.15 * m.importance, 6) as score from memories m join via on via.id = m.id where {_LIVE}
        order by score desc, m.id limit 4""",
    "entity_lookup": f"""select m.id, importance, valid_at, via from memories m join (select memory_id, min(name) as via from memory_entities join entities e on e.id = entity_id
        where contains(lower(name), 'nation_1') group by 1) v on v.memory_id = m.id where {_LIVE} and namespace = 'en' order by importance desc, m.id limit 20""",
    "entity_lookup_fallback": f"select id, importance, valid_at, via_entity as via from ({_recall("namespace = 'en'", "namespace = 'en'")})",
    "entity_memories": f"""select id, namespace, importance from memories where {_LIVE} and id in (
        select memory_id from memory_entities where entity_id in (select id from entities where contains(lower(name), 'nation_1')))
        order by importance desc, id limit 8""",
    "graph_neighbors": f"""select distinct s.name as src, relation, d.name as dst, valid_from, valid_to from entity_edges e join entities s on s.id = src_id
        join entities d on d.id = dst_id where {_OPEN} and (s.name = 'NATION_3' or d.name = 'NATION_3')""",
    "graph_neighbors_as_of": """select distinct s.name as src, relation, d.name as dst, valid_from, valid_to from entity_edges e join entities s on s.id = src_id
        join entities d on d.id = dst_id where valid_from <= timestamp '2024-01-20' and (valid_to is null or valid_to > timestamp '2024-01-20')
        and (s.name = 'NATION_3' or d.name = 'NATION_3')""",
    "graph_traverse_out": _walk("Customer#000000007", 2, direction="out"),
    "graph_traverse_in": _walk("ASIA", 2, direction="in", types="and entity_type in ('agent', 'venture')"),
    "graph_traverse_both": _walk("Supplier#000000003", 3, limit=200),
    "graph_traverse_as_of": _walk(
        "NATION_3", 2, "valid_from <= timestamp '2024-01-20' and (valid_to is null or valid_to > timestamp '2024-01-20') and relation in ('MEMBER_OF', 'BELONGS_TO')"
    ),
    "graph_shortest_path": f"""with recursive steps as (select distinct x, y from (select src_id x, dst_id y from entity_edges where {_OPEN}
          union all select dst_id, src_id from entity_edges where {_OPEN})),
        walk(id, path, names, depth) as (
          select id, [id], [name], 0 from entities where name = 'Customer#000000007'
          union all select y, list_append(path, y), list_append(names, e.name), depth + 1 from walk join steps on x = walk.id join entities e on e.id = y
          where depth < 4 and not list_contains(path, y))
        select path, hops from (
          select array_to_string(names, ' > ') as path, cast(depth as integer) as hops, path as ids from walk
          where id = (select id from entities where name = 'Customer#000000002')
          union all select null, -1, null) order by hops < 0, hops, ids limit 1""",
    "graph_spine": _spine("true", "'repo', 'venture', 'feed'", 10),
    "graph_spine_by_id": _spine("true", "'repo', 'venture', 'feed'", 10, "n7"),
    "graph_spine_asked_roles": f"""select a.role, coalesce(total, 0) as total, rank, name, depth, relation from (values ('venture'), ('nobody'), ('repo')) a(role)
        left join ({_spine("true", "'repo', 'venture', 'feed'", 3)}) s on s.role = a.role""",
    "graph_spine_candidates": """select name, entity_type from entities where contains(lower(name), 'nation_2')
        order by entity_type in ('portfolio', 'venture') desc, length(name), name limit 10""",
    "graph_spine_window": _spine(
        "(e.entity_type <> 'person' or w.since between timestamp '2024-01-10' and timestamp '2024-02-10')", "'venture'", 5
    ),
    "graph_communities": _propagation(8) + "\nselect id, label from l8",
    "community_leads": _propagation(8)
    + """\nselect label, count(*) as size, 'cluster: ' || arg_min(name, (case entity_type when 'portfolio' then 0 when 'venture' then 1 else 2 end, name)) as name
        from l8 join entities using (id) group by label having count(*) > 1""",
    "graph_degree": f"""select id, count(*) as degree from (select src_id as id from entity_edges where {_OPEN}
        union all select dst_id from entity_edges where {_OPEN}) group by id""",
    "graph_sample_quota": f"""with degree as (select id, count(*) as degree from (select src_id as id from entity_edges where {_OPEN}
          union all select dst_id from entity_edges where {_OPEN}) group by id)
        select id, name, entity_type, degree from (select e.*, coalesce(d.degree, 0) as degree,
          row_number() over (partition by entity_type order by coalesce(d.degree, 0) desc, name) as r from entities e left join degree d using (id))
        where r <= 500 order by degree desc, entity_type, name limit 3000""",
    "graph_sample_edges": f"""with degree as (select id, count(*) as degree from (select src_id as id from entity_edges where {_OPEN}
          union all select dst_id from entity_edges where {_OPEN}) group by id),
        kept as (select id from (select e.*, coalesce(d.degree, 0) as degree,
          row_number() over (partition by entity_type order by coalesce(d.degree, 0) desc, name) as r from entities e left join degree d using (id))
        where r <= 500)
        select src_id, relation, dst_id from entity_edges where {_OPEN} and src_id in (select id from kept) and dst_id in (select id from kept)""",
    "graph_type_counts": "select entity_type, count(*) as nodes from entities group by 1",
    "graph_relation_counts": "select relation, count(*) as edges, count(*) filter (valid_to is null) as open from entity_edges group by 1",
    "graph_cooccurrence": """select x.name as a_name, y.name as b_name, memories from (
        select a.entity_id as a, b.entity_id as b, count(*) as memories from memory_entities a join memory_entities b
          on a.memory_id = b.memory_id and a.entity_id < b.entity_id group by 1, 2 order by memories desc, a, b limit 50)
        join entities x on x.id = a join entities y on y.id = b""",
    "derived_mindmap": r"""select namespace, type, total, cast(rank as integer) as rank, label from (
        select namespace, type, label, count(*) over (partition by namespace, type) as total, row_number() over (partition by namespace, type order by id) as rank from (
          select id, namespace, coalesce(nullif(domain_raw, ''), 'item') as type, substring(trim(regexp_replace(coalesce(nullif(json_extract_string(try_cast(metadata as json), '$.slug'), ''), content), '\s+', ' ', 'g')), 1, 48) as label
          from memories where invalid_at is null)) where rank <= 4""",
    "ontology_counts": "select d.name, count(e.id) as nodes from declared_types d left join entities e on e.entity_type = d.name group by 1",
    "ontology_undeclared": "select entity_type, count(*) as nodes from entities where entity_type not in (select name from declared_types) group by 1",
    "ontology_reconciled": """select coalesce(d.name, e.name) as name, case when d.name is not null then 'declared' else 'observed' end as origin, coalesce(n, 0) as nodes
        from declared_types d full join (select entity_type as name, count(*) as n from entities group by 1) e on e.name = d.name""",
    "fk_edge_families": _families(FAMILIES),
    "fk_edge_provenance": f"""with e as (select distinct src, dst, relation, ref from ({_families(("DISCUSSED_IN", "AGENT_DISCUSSED_IN", "TARGETS", "ATTENDED"))})),
        ranked as (select *, row_number() over (partition by src, dst, relation order by ref) as r from e)
        select src, dst, relation, case when count(*) = 1 then 'link' else 'aggregate' end as kind, count(*) as records, string_agg(ref, ',' order by ref) filter (r <= 8) as refs
        from ranked group by 1, 2, 3""",
    "attended_with": """with m as (select distinct event_id // 4 as meeting, user_id from events)
        select a.user_id as src, b.user_id as dst, count(*) as times, 'ATTENDED_WITH' as relation from m a join m b on a.meeting = b.meeting and a.user_id < b.user_id group by 1, 2""",
    "edge_endpoint_types": f"select * from ({_ENDS})",
    "ontology_to_register": f"""select 'entity_type' as kind, entity_type as name, cast(count(*) as varchar) as detail from entities where entity_type not in (select name from declared_types) group by 2
        union all select 'edge_type', relation, cast(count(*) as varchar) from entity_edges where {_OPEN} and relation not in (select name from declared_relations) group by 2
        union all select 'endpoint types', relation, concat(src_types, ' -> ', dst_types) from ({_ENDS}) e left join declared_relations d on d.name = e.relation
          where (d.src_type, d.dst_type) is distinct from (src_types, dst_types)""",
    "graph_sample_fallback": """with kept as (select id from entities where entity_type in ('venture', 'person')),
        held as (select distinct memory_id, entity_id from memory_entities where entity_id in (select id from kept))
        select distinct a.entity_id as src_id, '' as relation, b.entity_id as dst_id from held a join held b on a.memory_id = b.memory_id and a.entity_id < b.entity_id
        order by src_id, dst_id limit 100""",
    "venture_graph_nodes": f"""with {_SAID} select 'root' as id, 'en' as name, 'root' as "group" union all select distinct concat('pf:', portfolio), portfolio, 'portfolio' from ventures_said
        union all select distinct concat('v:', venture), venture, 'venture' from ventures_said union all select concat('type:', type), concat(type, ' (', n, ')'), 'type' from kinds
        union all select concat('ent:', id), name, type from linked union all select concat('ent:', id), name, type from few where id not in (select id from linked)""",
    "venture_graph_edges": f"""with {_SAID} select distinct 'root' as source, concat('pf:', portfolio) as target from ventures_said
        union all select concat('pf:', portfolio), concat('v:', venture) from ventures_said union all select concat('v:', venture), concat('ent:', id) from linked
        union all select 'root', concat('type:', type) from kinds union all select concat('type:', type), concat('ent:', id) from few""",
    "hop_trace": f"""with {_STEPS.format(w=_OPEN)}, root as (select id from entities where name = 'NATION_7'),
        first as (select distinct relation, y from steps where x in (select id from root)),
        second as (select f.relation, count(distinct s.y) as n from first f join steps s on s.x = f.y where s.y not in (select id from root) group by 1)
        select f.relation, count(*) as first_hop, coalesce(any_value(s.n), 0) as second_hop from first f left join second s on s.relation = f.relation group by 1""",
    "rollup_repo_weekly": f"""with {_COMMITS16}, who as (select week, repo_full_name, person, count(*) as n from recent group by all),
        ranked as (select *, row_number() over (partition by week, repo_full_name order by n desc, person) as r from who),
        by_repo as (select week, repo_full_name, cast(sum(n) as bigint) as total, count(*) as contributors, {_list('person', 'n')} filter (r <= 5) as who from ranked group by 1, 2),
        kept as (select *, row_number() over (partition by week order by total desc, repo_full_name) as rank from by_repo)
        select concat_ws(':', 'rollup:repo', cast(week as varchar), repo_full_name) as source_ref, {_label('week')} as period, cast(rank as integer) as rank,
          total as commits, contributors, concat(repo_full_name, ' had ', total, ' commits by ', contributors, ' people: ', who) as content,
          cast(week + 6 as date) as period_end, week + 6 > (select max(day) from github_commits) as partial from kept where rank <= 12 and total >= 3""",
    "rollup_person_weekly": f"""with {_COMMITS16}, by_repo as (select week, person, repo_full_name, count(*) as n, sum(additions) as a, sum(deletions) as d from recent group by all),
        ranked as (select *, row_number() over (partition by week, person order by n desc, repo_full_name) as r from by_repo),
        by_person as (select week, person, cast(sum(n) as bigint) as total, count(*) as repos, cast(sum(a) as bigint) as additions, cast(sum(d) as bigint) as deletions,
          {_list('repo_full_name', 'n')} filter (r <= 3) as top_repos from ranked group by 1, 2),
        kept as (select *, row_number() over (partition by week order by total desc, person) as rank from by_person)
        select {_label('week')} as period, person, cast(rank as integer) as rank, total as commits, repos, additions, deletions, top_repos
        from kept where rank <= 12 and total >= 3""",
    "rollup_claude_person_weekly": f"""with {_CLAUDE16}, by_user as (select week, user_id, count(*) as events, cast(sum(total_tokens) as bigint) as tokens from recent group by 1, 2)
        select week, user_id, events, tokens, cast(rank as integer) as rank, "of" from (
          select *, row_number() over (partition by week order by events desc, user_id) as rank, count(*) over (partition by week) as "of" from by_user) where events >= 5""",
    "rollup_studio_weekly": f"""with {_COMMITS16},
        p as (select week, person, count(*) as n, row_number() over (partition by week order by count(*) desc, person) as r from recent group by 1, 2),
        q as (select week, repo_full_name as repo, count(*) as n, row_number() over (partition by week order by count(*) desc, repo_full_name) as r from recent group by 1, 2),
        o as (select week, org_slug as org, count(*) as n, row_number() over (partition by week order by count(*) desc, org_slug) as r from recent group by 1, 2),
        t as (select week, count(*) as commits, count(distinct person) as people, count(distinct repo_full_name) as repos from recent group by 1),
        ai as (select {_week('created_at')} as week, count(*) as n from claude_activity_events group by 1)
        select t.week, commits, people, repos, (select {_list('person', 'n')} from p where p.week = t.week and r <= 5) as top_people,
          (select {_list('repo', 'n')} from q where q.week = t.week and r <= 5) as top_repos,
          (select {_list('org', 'n')} from o where o.week = t.week and r <= 4) as top_orgs, coalesce(ai.n, 0) as ai_events
        from t left join ai on ai.week = t.week""",
    "leaderboard_weekly": f"""with {_COMMITS16}, by_person as (select week, person, count(*) as commits from recent group by 1, 2),
        ranked as (select *, row_number() over (partition by week order by commits desc, person) as best, row_number() over (partition by week order by commits, person) as least from by_person)
        select week, person, commits, cast(best as integer) as best, cast(least as integer) as least, week = (select max(week) from by_person) as is_last_week
        from ranked where best <= 5 or least <= 5""",
    "leaderboard_idle": f"""with {_COMMITS16},
        grid as (select distinct w.week, p.person from (select distinct week from recent) w, (select person from people union select agent_id from agent_actions) p)
        select week, count(*) as idle, string_agg(person, ', ' order by person) as people from grid g
        where not exists (select 1 from recent r where r.week = g.week and r.person = g.person) group by week""",
    "rollup_studio_claude_weekly": f"""with {_CLAUDE16}, by_user as (select week, cast(user_id as varchar) as u, count(*) as e, cast(sum(total_tokens) as bigint) as t from recent group by 1, 2),
        ranked as (select *, row_number() over (partition by week order by e desc, u) as re, row_number() over (partition by week order by t desc, u) as rt from by_user)
        select week, cast(sum(e) as bigint) as events, count(*) as users, cast(sum(t) as bigint) as tokens, {_list('u', 'e')} filter (re <= 5) as top_by_events,
          {_list('u', 't')} filter (rt <= 3) as top_by_tokens from ranked group by week""",
    "rollup_org_monthly": f"""with by_login as (select cast(date_trunc('month', day) as date) as month, org_slug, author_login, count(*) as n,
          row_number() over (partition by date_trunc('month', day), org_slug order by count(*) desc, author_login) as r from github_commits group by 1, 2, 3, date_trunc('month', day)),
        merged as (select month, org_slug, coalesce(p.person, author_login) as person, cast(sum(n) as bigint) as n from by_login left join people p on p.login = author_login
          where r <= 12 group by 1, 2, 3),
        top as (select *, row_number() over (partition by month, org_slug order by n desc, person) as r from merged)
        select b.month, b.org_slug, cast(sum(b.n) as bigint) as commits, count(*) as logins,
          (select {_list('person', 'n')} from top t where t.month = b.month and t.org_slug = b.org_slug and t.r <= 5) as top_people
        from by_login b group by 1, 2""",
    "rollup_studio_monthly": """with e as (
          select cast(date_trunc('month', day) as date) as month, 'c' as k, true as done from github_commits
          union all select cast(date_trunc('month', created_at) as date), 'p', merged_at is not null from github_pull_requests
          union all select cast(date_trunc('month', created_at) as date), 'a', true from claude_activity_events
          union all select cast(date_trunc('month', created_at) as date), 'i', true from issue_activity)
        select month, count(*) filter (k = 'c') as commits, count(*) filter (k = 'p') as pulls, count(*) filter (k = 'p' and done) as merged,
          count(*) filter (k = 'a') as ai_events, count(*) filter (k = 'i') as issue_events from e group by month""",
    "productivity_person_week": f"""with git as (select {_week('c.day')} as week, {_PERSON} as person, count(*) as commits, cast(sum(additions) as bigint) as additions
          from github_commits c left join people p on p.login = c.author_login group by 1, 2),
        ai as (select {_week('created_at')} as week, coalesce(u.person, concat('user:', c.user_id)) as person, count(*) as ai_events, {_COST} as cost
          from claude_activity_events c left join user_people u on u.user_id = c.user_id group by 1, 2)
        select coalesce(git.week, ai.week) as week, coalesce(git.person, ai.person) as person, coalesce(commits, 0) as commits, coalesce(additions, 0) as additions,
          coalesce(ai_events, 0) as ai_events, cast(coalesce(cost, 0) as double) as cost from git full join ai on git.week = ai.week and git.person = ai.person""",
    "ai_spend_weekly": f"""select {_week('created_at')} as week, count(distinct user_id) as people, cast(sum(total_tokens) as bigint) as tokens, cast({_COST} as double) as cost
        from claude_activity_events group by 1""",
    "used_ai_on_edges": """select c.user_id as src, 'USED_AI_ON' as relation, r.repo as dst, count(*) as weight, min(c.created_at) as since from claude_activity_events c
        join (select lower(p_brand) as base, min(p_brand) as repo from part group by 1 having count(distinct p_brand) = 1) r
          on r.base = lower(list_last(string_split(c.cwd, '/'))) where c.cwd is not null group by 1, 2, 3""",
    "repo_link_cascade": r"""with v as (select *, regexp_replace(lower(regexp_extract(url, 'github\.com[:/]+([^/\s]+/[^/\s#?]+)', 1)), '\.git$', '') as site from venture_sites),
        keys as (select key, min(id) as id from (select regexp_replace(lower(name), '[^a-z0-9]', '', 'g') as key, id from v union all select lower(id), id from v) where length(key) >= 4 group by 1)
        select repo, target, case rule when 'portfolio' then 'REPO_IN' else 'REPO_OF' end as relation, rule from (
          select r.repo, coalesce(s.id, ov.id, k.id, o.portfolio_id) as target,
            case when s.id is not null then 'url' when ov.id is not null then 'org' when k.id is not null then 'name' else 'portfolio' end as rule
          from repositories r left join (select site, min(id) as id from v where site <> '' group by 1) s on s.site = lower(r.repo)
          left join organisations o on lower(o.org) = split_part(lower(r.repo), '/', 1) left join v ov on ov.id = o.venture_id
          left join keys k on k.key = regexp_replace(lower(split_part(r.repo, '/', 2)), '[^a-z0-9]', '', 'g')) where target is not null""",
    "pr_activity_digest": f"""select repo_full_name, count(*) as opened, count(merged_at) as merged, count(*) filter (first_review_at is null) as never_reviewed,
        round(median({_MINUTES.format('created_at', 'first_review_at')} / 60.0::double), 1) as median_review_hours,
        round(median({_MINUTES.format('created_at', 'merged_at')} / 60.0::double), 1) as median_merge_hours from github_pull_requests group by 1""",
    "thread_digest": r"""select conv_id, n as turns, string_agg(role || ': ' || substring(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 1, 80), ' | ' order by r desc) as content from (
        select *, row_number() over (partition by conv_id order by turn desc, role desc) as r, count(*) over (partition by conv_id) as n from conversations)
        where r <= 3 group by 1, 2""",
    "agent_week_digest": f"""with a as (select *, {_week('created_at')} as week, substring(summary, 1, 45) as short from agent_actions),
        latest as (select agent_id, venture_id, week, short, max(created_at) as latest_at from a group by all),
        head as (select *, row_number() over (partition by agent_id, venture_id, week order by latest_at desc, short) as r from latest)
        select agent_id, venture_id, week, count(*) as actions, count(distinct kind) as kinds,
          (select string_agg(short, '; ' order by r) from head h where h.agent_id = a.agent_id and h.venture_id = a.venture_id and h.week = a.week and r <= 25) as content
        from a group by 1, 2, 3""",
    "rollup_changed_only": "select concat('doc:', doc_id) as source_ref, substring(sha256(text), 1, 16) as hash from documents where doc_id % 10 = 0",
    "prune_stale_refs": """select id, source_ref || '/' || id as source_ref from memories where invalid_at is null and source_kind in ('src1', 'src2')
        and cast(substring(id, 2) as bigint) % 3 = 0""",
    "coverage_gap": """select repo_full_name, count(*) as commits from github_commits where day > (select max(day) from github_commits) - 90
        and repo_full_name not in (select repo from repo_links where org = 'org0' and url_venture = 'v5') group by 1 order by commits desc, repo_full_name limit 10""",
    "edge_provenance_classify": """with e as (select distinct concat('c', o_custkey) as src, concat('n', o_orderkey % 25) as dst, concat('db:order:', o_orderkey) as ref from orders),
        r as (select *, row_number() over (partition by src, dst order by ref) as r, count(*) over (partition by src, dst) as n from e)
        select src, dst, 'ORDERED_IN' as relation, case when n = 1 then 'link' else 'aggregate' end as kind, n as records, string_agg(ref, ',' order by ref) as refs
        from r where r <= 8 group by src, dst, n""",
    "episodes_latest": """select namespace, source_ref, id, concat(upper(substring(k, 1, 1)), substring(k, 2), ' · ', substring(split_part(content, chr(10), 1), 1, 90)) as label from (
        select *, replace(coalesce(source_kind, 'memory'), '-', ' ') as k,
          row_number() over (partition by namespace, source_ref order by invalid_at is null desc, valid_at desc, id desc) as r from memories) where r = 1""",
    "graph_candidates": """select name, entity_type from entities where contains(lower(name), 'nation_1')
        order by entity_type in ('portfolio', 'venture') desc, length(name), name limit 10""",
    "graph_spine_roles": f"""select role, max(total) as total, count(*) as shown, cast(case role when 'portfolio' then 1 when 'venture' then 2 when 'repo' then 3
        when 'person' then 4 when 'agent' then 5 else 18 end as integer) as place from ({_spine("true", "'repo', 'venture', 'feed'", 10)}) group by role""",
    "graph_labels": """with nodes as (select concat('r:', p_brand) as id, p_brand as name, 'repo' as kind from part
          union all select concat('t:', p_brand, ':', p_partkey), p_brand, 'team' from part),
        one as (select name, kind, min(id) as id, count(*) over (partition by name) as kinds from nodes group by name, kind)
        select id, kind, case when kinds > 1 then concat(name, ' (', kind, ')') else name end as label from one""",
    "graph_activity_nodes": f"""with {_COMMITS16}, by_repo as (select week, repo_full_name as repo, count(*) as n from recent group by 1, 2),
        kept as (select *, row_number() over (partition by week order by n desc, repo) as rank from by_repo)
        select concat_ws(':', 'activity', repo, {_label('week')}) as src, 'ACTIVITY_OF' as relation, repo as dst, n as weight from kept where rank <= 12 and n >= 3""",
    "feed_nodes": f"""with own_posts as (select event_type as kind, user_id as author, coalesce(case when event_id % 3 <> 0 then concat('v', user_id % 25) end,
          case when user_id % 10 < 5 then concat('v', user_id % 10) end, 'studio') as venture from events),
        kinds as (select venture, kind, count(*) as n, row_number() over (partition by venture order by count(*) desc, kind) as r from own_posts group by 1, 2)
        select concat('feed:', k.venture) as feed, cast(sum(n) as bigint) as posts, {_list('kind', 'n')} filter (r <= 3) as kinds,
          (select count(distinct author) from own_posts p where p.venture = k.venture) as authors from kinds k group by k.venture""",
    "meeting_title_match": """with tok as (select token, min(id) as venture_id from (
          select id, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as token from dim_ventures union select id, lower(id) from dim_ventures)
          where length(token) >= 4 group by token having count(distinct id) = 1),
        titles as (select event_id as id, lower(concat('Sync: nation_', event_id % 40, case when event_id % 7 = 0 then ' and NATION_1' else '' end)) as title from events),
        named as (select distinct t.id, venture_id from titles t join tok on list_contains(regexp_extract_all(title, '[a-z0-9]+'), token)
          or (length(token) >= 5 and contains(regexp_replace(title, '[^a-z0-9]', '', 'g'), token)))
        select id, 'MEETING_ABOUT' as relation, min(venture_id) as venture_id from named group by id having count(*) = 1""",
    "rollup_relink": """with head as (select c_nationkey, c_custkey from (select *, row_number() over (partition by c_nationkey order by c_name) as r from customer) where r <= 8)
        select concat('rollup:', c_nationkey) as source_ref, concat('c', c_custkey) as entity_id from head where c_custkey % 3 <> 0
        union all select distinct concat('rollup:', c_nationkey), concat('n', c_nationkey) from head""",
    "stale_edges_retired": f"""select src_id, relation, dst_id, valid_from, timestamp '2024-01-15 12:00:00' as valid_to from entity_edges
        where {_OPEN} and relation = 'MEMBER_OF' and cast(substring(src_id, 2) as bigint) % 3 = 0""",
    "edges_to_open": "select distinct src_id, relation, dst_id from entity_edges where valid_to is not null",
    "mirror_links": f"""select distinct namespace, memory_id, entity_id from (
        select case when length(memory_id) % 2 = 0 then 'en' else 'fr' end as namespace, memory_id, entity_id from memory_entities)
        where (namespace, memory_id) in (select (namespace, id) from memories where {_LIVE})""",
    "provenance_stats": """with e as (select concat('c', o_custkey) as src, concat('n', o_orderkey % 25) as dst, count(*) as n from orders group by 1, 2)
        select 'ORDERED_IN' as relation, case when n = 1 then 'link' else 'aggregate' end as kind, count(*) as edges, cast(sum(n) as bigint) as records from e group by 2""",
    "brain_facets": f"""select facet, value, count(*) as memories, count(*) filter (importance >= 0.7) as important from (
        select 'namespace' as facet, namespace as value, importance from memories where {_LIVE} union all select 'source_kind', source_kind, importance from memories where {_LIVE}
        union all select 'domain_raw', domain_raw, importance from memories where {_LIVE}) where value is not null group by 1, 2""",
    "search_scoped": f"select id, namespace from memories where {_LIVE} and namespace = 'en'",
    "write_decision_by_ref": f"""with newest as (select namespace, source_ref, arg_max(id, (valid_at, id)) as top_id from memories where {_LIVE} group by 1, 2),
        new as (select concat('new', doc_id) as id, lang as namespace, concat('doc:', cast(floor(doc_id / 2.0) as bigint)) as source_ref from documents)
        select id, new.source_ref, top_id, case when top_id is null then 'add' else 'update' end as decision from new left join newest using (namespace, source_ref)""",
    "write_applied": f"""with decided as (SELECT_DECISIONS),
        hits as (select top_id as id, count(*) filter (decision = 'noop') as noops, max(case when decision = 'update' then id end) as superseded_by,
          count(*) filter (decision in ('update', 'invalidate')) as gone from decided where decision <> 'add' group by 1)
        select m.id, coalesce(gone, 0) = 0 as live, superseded_by, round(least(1.0::double, importance + 0.02::double * coalesce(noops, 0)), 6) as importance
        from memories m left join hits h on h.id = m.id where {_LIVE} and embedding is not null
        union all select id, true, null, 0.5::double from decided where decision in ('add', 'update')""",
    "memory_forget": f"""select id, timestamp '2024-01-15 12:00:00' as invalid_at, {_merged("json_object('forget_reason', 'outdated')")} as metadata
        from memories where invalid_at is null and importance > 0.85::double""",
    "coverage_share": """select count(*) as events, count(cwd) as with_cwd, round(100.0::double * count(cwd) / count(*), 1) as share,
        cast(min(created_at) as date) as first_day, cast(max(created_at) as date) as last_day from claude_activity_events""",
    "commits_by_username": "select person, count(*) as commits from github_commits join people on lower(author_login) = lower(login) group by 1",
    "mapping_memories": """select concat('db:post-thread:', o_orderkey) as source_ref, 'en' as namespace, 'post_thread' as source_kind, 'post-thread' as domain_raw, o_orderdate as valid_at,
        concat('Order ', o_orderkey, ' by ', coalesce(c_name, 'unknown'), ' (', coalesce(n_name, '-'), '), status ', o_orderstatus, ', priority ', o_orderpriority) as content,
        0.45::double as importance from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey""",
    "mapping_nation_people": """select cast(n_nationkey as bigint) as ref_id, concat(n_name, ': ', coalesce((select string_agg(s_name, ', ' order by s_name) from supplier
        where s_nationkey = n_nationkey), 'nobody')) as content from nation""",
    "deployment_digest": """select venture_id, count(*) as runs, count(*) filter (kind = 'signup') as failed, array_to_string(list_sort(list(distinct agent_id)), ', ') as "by"
        from agent_actions group by 1""",
    "pulse_survey_digest": r"""with a as (select concat('s', conv_id % 5) as survey, role as key, case when turn % 3 = 0 then concat('c', conv_id % 4) end as choice,
          case when turn % 3 <> 0 then text end as text, conv_id * 1000 + turn as said_at from conversations),
        t as (select survey, string_agg(concat('[', key, '] ', substring(regexp_replace(text, '\s+', ' ', 'g'), 1, 220)), ' | ' order by r) as texts from (
          select *, row_number() over (partition by survey order by said_at desc, key, text) as r from a where length(text) >= 12) where r <= 24 group by 1),
        c as (select survey, string_agg(concat(key, ': ', choice, ' x', n), ', ' order by key, n desc, choice) as choices from (
          select survey, key, choice, count(*) as n from a where choice is not null group by all) group by 1)
        select survey, responses, concat('Survey ', survey, '. Responses: ', responses, '.', case when texts is not null then concat(' Free-text answers (verbatim): ', texts) else '' end,
          case when choices is not null then concat(' Choices: ', choices) else '' end) as content
        from (select survey, count(*) as responses from a group by 1) left join t using (survey) left join c using (survey)""",
    "doc_collection": """with f as (select case doc_id % 5 when 0 then concat('pkg', doc_id, '/README.md') when 1 then concat('docs/g', doc_id, '.mdx') when 2 then concat('src/n', doc_id, '.md') end as path,
          case doc_id % 5 when 0 then 0 when 1 then 1 else 2 end as place, length(text) as bytes, length(trim(text)) as n from documents)
        select path, cast(place as integer) as place, bytes from f where path is not null and bytes <= 400000 and n >= 120""",
    "code_shortlist": """with f as (select concat('src/', lower(p_type), '/', case when p_partkey % 5 = 0 then 'handler_' else '' end, replace(p_name, ' ', '_'), '_', p_partkey, '.go') as path,
          p_size * 1000 as bytes from part),
        s as (select path, regexp_replace(path, '/[^/]*$', '') as dir, round(case when contains(path, 'handler') then 7.0 else 0 end
          + case when contains(path, 'widget') then -3.0 else 0 end - 0.8 * 2 + case when bytes between 800 and 25000 then 3.0 else 0 end, 6) as score
          from f where bytes between 250 and 60000),
        r as (select *, row_number() over (partition by dir order by score desc, path) as r from s)
        select path, cast(score as double) as score from r where r <= 3 order by score desc, path limit 14""",
    "repository_overview": f"""with f as (select p_brand as repo, concat('src/', lower(p_type), '/', case when p_partkey % 5 = 0 then 'handler_' else '' end, replace(p_name, ' ', '_'), '_', p_partkey, '.go') as path, lower(p_type) as language, p_size * 1000 as bytes from part),
        l as (select repo, language, count(*) as n from f group by 1, 2),
        b as (select *, row_number() over (partition by repo order by bytes desc, path) as r from f)
        select repo, cast(sum(n) as bigint) as files, {_list('language', 'n')} as languages,
          (select string_agg(path, ', ' order by r) from b where b.repo = l.repo and r <= 3) as largest from l group by repo""",
    "etl_stats": """select 'events' as "table", max(ts) as max_time, count(*) as row_count, timestamp '2024-01-15 12:00:00' as last_run, 'full' as last_mode from events
        union all select 'pulls', max(created_at), count(*), timestamp '2024-01-15 12:00:00', 'full' from github_pull_requests
        union all select 'actions', max(created_at), count(*), timestamp '2024-01-15 12:00:00', 'full' from agent_actions""",
    "html_to_text": f"""select ref, sha256(content) as content_sha, cast(length(content) as integer) as n_chars, coalesce(nullif(trim(title), ''), ref) as title from (
        select url as ref, {_HTML} as content, {_decoded("regexp_extract(substring(coalesce(html, ''), 1, 4194304), '(?is)<title[^>]*>(.*?)</title>', 1)")} as title from pages)
        where content <> ''""",
    "sql_rows_to_documents": r"""select cast(c_custkey as varchar) as ref, c_name as title, concat_ws(chr(10), 'c_custkey: ' || c_custkey, 'c_name: ' || c_name,
        'c_nationkey: ' || c_nationkey, 'c_acctbal: ' || c_acctbal, 'c_mktsegment: ' || c_mktsegment) as content, '{"type":"row"}' as metadata from customer""",
    "mapping_orders": """select concat('db:order:', o_orderkey) as ref_id, o_orderdate as event_time, concat('Order ', o_orderkey, ' by ', coalesce(c_name, 'unknown'), ' (',
        coalesce(n_name, '-'), '), status ', o_orderstatus, ', priority ', o_orderpriority) as content from orders left join customer on c_custkey = o_custkey
        left join nation on n_nationkey = c_nationkey""",
    "mapping_customer_orders": """select concat('db:customer:', c_custkey) as ref_id, concat(c_name, ': ', coalesce(l, 'no orders')) as content from customer left join (
        select o_custkey, string_agg(cast(o_orderkey as varchar), ', ' order by r) as l from (
          select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as r from orders) where r <= 3 group by 1) o on o.o_custkey = c_custkey""",
    "secret_screen": rf"""with m as (select conv_id as thread, turn, role, case when (conv_id + turn) % 4 = 0 then 'Pass: 123 ' || text else text end as body from conversations where conv_id % 9 <> 0),
        c as (select *, row_number() over (partition by thread order by turn desc, role, body) as r from m where body <> '' and not regexp_matches(body, '{CREDENTIAL}'))
        select thread, count(*) as messages, cast(sum(length(body)) as bigint) as substance,
          string_agg(role || ': ' || substring(regexp_replace(body, '\s+', ' ', 'g'), 1, 400), ' | ' order by r desc) as content from c where r <= 30 group by thread having sum(length(body)) >= 120""",
    "incremental_upsert": """select event_id, ts, event_type, case when ts >= timestamp '2024-01-08' and event_id % 7 = 0 then value + 1 else value end as value from events""",
    "late_data_dedupe": """select event_id, case when event_id % 5 = 0 then ts + interval 1 hour else ts end as ts, event_type,
        case when event_id % 5 = 0 then value + 1 else value end as value from events""",
    "etl_watermark": """select 'events' as "table", max(ts) as max_time, count(*) as row_count, timestamp '2024-01-15 12:00:00' as last_run, 'full' as last_mode from events""",
    "stream_monthly": "select cast(date_trunc('month', ts) as date) as month, event_type, count(distinct event_id) as events from events group by 1, 2",
    "stream_tumbling_weekly": "select cast(date_trunc('week', ts) as date) as week, event_type, count(*) as events from events group by all",
    "stream_tumbling_daily": "select cast(ts as date) as day, event_type, count(*) as events from events group by all",
}


SQL["write_applied"] = SQL["write_applied"].replace("SELECT_DECISIONS", SQL["write_decision"])


def _document(rows: str, kind: str, unit: str, subject: str, scope: str, content: str, metrics: str, newest: str) -> str:
    """A rollup's rows as documents; ``content`` and ``metrics`` name its columns."""
    label = _label(unit) if unit == "week" else "strftime(month, '%Y-%m')"
    end = "cast(week + 6 as date)" if unit == "week" else "last_day(month)"
    subject = f"{subject}, ':', " if subject else ""
    json = ", ".join(f"'{m}', {m}" for m in metrics.split(", "))
    return f"""select concat('rollup:{kind}:', {subject}{label}) as source_ref,
        concat({content}, case when {end} > newest then concat(' (The period is not over: data up to ', newest, '.)') else '' end) as content, {label} as period, {scope} as scope,
        least(cast({end} as timestamp) + interval '23 hours 59 minutes 59 seconds', timestamp '2024-01-15 12:00:00') as valid_at, {end} > newest as partial, 0.55::double as importance,
        cast(json_object('type', 'activity-rollup', 'period', '{unit}', 'scope', {scope}, {json}) as varchar) as metadata from ({rows}) q, (select {newest}) nn"""


def _thousands(c: str) -> str:
    return f"format('{{:,}}', {c})"


def _scaled(c: str) -> str:
    """Rounded half up, in whole numbers."""
    return f"""case when {c} >= 1000000000 then printf('%.2fB', (({c} + 5000000) // 10000000) / 100.0) when {c} >= 1000000 then printf('%.1fM', (({c} + 50000) // 100000) / 10.0)
      when {c} >= 1000 then printf('%.1fk', (({c} + 50) // 100) / 10.0) else cast({c} as varchar) end"""


_PHRASE = f"'ISO week ', {_label('week')}, ' (Monday ', week, ' to ', cast(week + 6 as date), ')'"
_NEWEST_COMMIT, _NEWEST_AI = "max(day) as newest from github_commits", "cast(max(created_at) as date) as newest from claude_activity_events"
_AI_ROWS = f"""select c.*, coalesce(u.person, concat('user:', c.user_id)) as who from ({SQL["rollup_claude_person_weekly"]}) c left join user_people u on u.user_id = c.user_id"""
_BOARD = f"""select b.*, i.idle, i.people as idle_people from (select week, string_agg(concat(person, ' (', commits, ')'), ', ' order by best) filter (best <= 5) as best_list,
    string_agg(concat(person, ' (', commits, ')'), ', ' order by least) filter (least <= 5) as least_list, bool_or(is_last_week) as last from ({SQL["leaderboard_weekly"]}) group by week) b
    left join ({SQL["leaderboard_idle"]}) i on i.week = b.week"""
_REPO_WEEKS = f"""with {_COMMITS16}, raw as (select {_week('day')} as week, * from github_commits where {_week('day')} >= (select {_week('max(day)')} - 105 from github_commits)),
    who as (select week, repo_full_name, person, count(*) as n from recent group by all),
    ranked as (select *, row_number() over (partition by week, repo_full_name order by n desc, person) as r from who),
    by_repo as (select week, repo_full_name, cast(sum(n) as bigint) as commits, {_list('person', 'n')} filter (r <= 5) as who from ranked group by 1, 2),
    kept as (select *, row_number() over (partition by week order by commits desc, repo_full_name) as rank from by_repo),
    more as (select week, repo_full_name, min(org_slug) as org, count(distinct author_login) as logins, count(distinct day) as days, cast(sum(additions) as bigint) as additions,
      cast(sum(deletions) as bigint) as deletions from raw group by 1, 2)
    select * from kept join more using (week, repo_full_name) where rank <= 12 and commits >= 3"""
_WORK = f"""with git as (select {_week('c.day')} as week, {_PERSON} as person, count(*) as commits, count(distinct repo_full_name) as repos, count(distinct c.day) as days,
      cast(sum(additions) as bigint) as additions, cast(sum(deletions) as bigint) as deletions from github_commits c left join people p on p.login = c.author_login group by 1, 2),
    ai as (select {_week('created_at')} as week, coalesce(u.person, concat('user:', c.user_id)) as person, count(*) as events, count(distinct session_id) as sessions, cast(sum(input_tokens) as bigint) as input,
      cast(sum(output_tokens) as bigint) as output, cast(sum(cache_read_tokens) as bigint) as cache_read, cast(sum(cache_creation_tokens) as bigint) as cache_write, cast(sum(total_tokens) as bigint) as tokens
      from claude_activity_events c left join user_people u on u.user_id = c.user_id where c.user_id is not null group by 1, 2)
    select *, (input * 3.0::double + output * 15.0::double + cache_read * 0.3::double + cache_write * 3.75::double) / 1e6::double as cost from git full join ai using (week, person)"""
_ESTIMATED = " The cost is an estimate from token counts and list prices, as neither model nor price is recorded; use is known by person and not by project."
_money = lambda c: f"'$', format('{{:,.2f}}', {c})"
SQL["used_ai_on_facts"] = f"""with e as (select *, lower(regexp_extract(regexp_replace(cwd, '[\\\\/]+$', ''), '[^\\\\/]*$')) as base from claude_activity_events where cwd is not null),
    r as (select lower(p_brand) as base, min(p_brand) as repo from part group by 1 having count(distinct p_brand) = 1),
    g as (select coalesce(u.person, concat('user:', e.user_id)) as src, repo as dst, count(*) as weight, cast(sum(total_tokens) as bigint) as tokens, cast(max(created_at) as date) as last_day
      from e join r using (base) left join user_people u on u.user_id = e.user_id group by 1, 2),
    c as (select count(*) as whole, count(cwd) as known, cast(min(created_at) filter (cwd is not null) as date) as low, cast(max(created_at) filter (cwd is not null) as date) as high from claude_activity_events)
    select src, 'USED_AI_ON' as relation, dst, weight, tokens, last_day, concat(src, ' worked in the folder of ', dst, ' in ', {_thousands("weight")}, ' AI events (', {_scaled("tokens")}, ' tokens), last on ',
      last_day, '. A folder is known for ', {_thousands("known")}, ' of ', {_thousands("whole")}, ' events (', format('{{:,.1f}}', 100.0::double * known / whole), '%), from ', low, ' to ', high,
      ': a sign of use, no measure of it.') as fact from g, c"""
SQL |= {
    "rollup_docs_repo": _document(
        _REPO_WEEKS, "commits", "week", "repo_full_name", "concat('repo:', repo_full_name)",
        f"""'In ', {_PHRASE}, ' the repository ', repo_full_name, ' of ', org, ' had ', {_thousands('commits')}, ' commits by ', logins, ' logins on ', days, ' days, +', {_thousands('additions')}, '/-',
        {_thousands('deletions')}, ' lines (', {_thousands('(additions - deletions)')}, ' net). Most by: ', who, '.'""", "commits, logins, days", _NEWEST_COMMIT),
    "rollup_docs_ai_spend": _document(
        SQL["ai_spend_weekly"], "ai-spend", "week", "", "'studio'",
        f"""'AI use of all in ', {_PHRASE}, ': ', people, ' people, ', {_scaled('tokens')}, ' tokens, about ', {_money('cost')}, '.{_ESTIMATED}'""", "people, tokens", _NEWEST_AI),
    "rollup_docs_productivity": _document(
        _WORK, "productivity", "week", "person", "concat('person:', person)",
        f"""'Work of ', person, ' in ', {_PHRASE}, ':', case when commits is null then ' No commits.' else concat(' ', {_thousands('commits')}, ' commits in ', repos, ' repositories on ', days, ' days, +',
        {_thousands('additions')}, '/-', {_thousands('deletions')}, ' lines.') end, case when events is null then ' No AI use.' else concat(' ', {_thousands('events')}, ' AI events in ', {_thousands('sessions')},
        ' sessions, ', {_scaled('tokens')}, ' tokens (', {_scaled('input')}, ' input, ', {_scaled('output')}, ' output, ', {_scaled('cache_read')}, ' read from cache, ', {_scaled('cache_write')},
        ' written to cache), about ', {_money('cost')}, '.') end, case when commits is not null and events is not null then concat(' Per commit: ', {_money('cost / commits')}, ' and ',
        {_thousands('tokens // commits')}, ' tokens.') else '' end, '{_ESTIMATED}'""", "commits, events",
        "greatest((select max(day) from github_commits), (select cast(max(created_at) as date) from claude_activity_events)) as newest"),
    "rollup_docs_person": _document(
        SQL["rollup_person_weekly"].replace(f"select {_label('week')} as period", f"select week, {_label('week')} as period"), "person-commits", "week", "person", "concat('person:', person)",
        f"""'In ', {_PHRASE}, ' ', person, ' made ', {_thousands('commits')}, ' commits in ', repos, ' repositories, +', {_thousands('additions')}, '/-', {_thousands('deletions')},
        ' lines. Most in: ', top_repos, '.'""", "commits, repos", _NEWEST_COMMIT),
    "rollup_docs_ai_person": _document(
        _AI_ROWS, "ai", "week", "user_id", "concat('person:', who)",
        f"""'In ', {_PHRASE}, ' ', who, ' used the AI assistant for ', {_thousands('events')}, ' events and ', {_scaled('tokens')}, ' tokens: rank ', rank, ' of ', "of", ' users.'""",
        "events, tokens, rank", _NEWEST_AI),
    "rollup_docs_studio": _document(
        SQL["rollup_studio_weekly"], "studio-commits", "week", "", "'studio'",
        f"""'All engineering in ', {_PHRASE}, ': ', {_thousands('commits')}, ' commits by ', people, ' people in ', repos, ' repositories. People: ', top_people, '. Repositories: ', top_repos,
        '. Organisations: ', top_orgs, '.', case when ai_events > 0 then concat(' AI events in the same week: ', {_thousands('ai_events')}, '.') else '' end""", "commits, people", _NEWEST_COMMIT),
    "rollup_docs_leaderboard": _document(
        _BOARD, "leaderboard", "week", "", "'studio'",
        f"""'Leaderboard of ', {_PHRASE}, case when last then ' (last week)' else '' end, '. Most commits: ', best_list, '. Least: ', least_list, '. No commits: ', coalesce(idle_people, '-'), '.',
        ' ترتيب الأعضاء في الأسبوع ', {_label('week')}, case when last then ' (الأسبوع الأخير)' else '' end, '. الأكثر نشاطا: ', best_list, '. الأقل نشاطا: ', least_list, '. بلا نشاط: ',
        coalesce(idle_people, '-'), '.'""", "idle", _NEWEST_COMMIT),
    "rollup_docs_studio_ai": _document(
        SQL["rollup_studio_claude_weekly"], "studio-ai", "week", "", "'studio'",
        f"""'AI use in ', {_PHRASE}, ': ', {_thousands('events')}, ' events by ', users, ' users, ', {_scaled('tokens')}, ' tokens. By events: ', top_by_events, '. By tokens: ', top_by_tokens, '.'""",
        "events, users, tokens", _NEWEST_AI),
    "rollup_docs_org": _document(
        SQL["rollup_org_monthly"], "org-commits", "month", "org_slug", "concat('org:', org_slug)",
        f"""'In ', strftime(month, '%Y-%m'), ' the organisation ', org_slug, ' had ', {_thousands('commits')}, ' commits by ', logins, ' logins. Most by: ', top_people, '.'""",
        "commits, logins", _NEWEST_COMMIT),
    "rollup_docs_studio_month": _document(
        SQL["rollup_studio_monthly"], "studio", "month", "", "'studio'",
        f"""'All work in ', strftime(month, '%Y-%m'), ': ', {_thousands('commits')}, ' commits, ', {_thousands('pulls')}, ' pull requests (', {_thousands('merged')}, ' merged), ',
        {_thousands('ai_events')}, ' AI events, ', {_thousands('issue_events')}, ' issue events.'""", "commits, pulls, merged", _NEWEST_COMMIT),
}


_FORMATS = {"@": "%Y-%m-%d", "#": "%H:%M", "%": "%Y-%m-%d %H:%M"}


def _said(sentence: str, optional: bool = False) -> str:
    def one(piece) -> str:
        if isinstance(piece, str):
            return "'" + piece.replace("'", "''") + "'"
        if piece["maybe"] is not None:
            return f"coalesce({_said(piece['maybe'], True)}, '')"
        found = []
        for n in piece["names"].split(","):
            text = f"""strftime("{n}", '{_FORMATS[piece["date"]]}')""" if piece["date"] else f'cast("{n}" as varchar)'
            found.append(f"nullif({text}, '')" if piece["bar"] == "||" else text)
        if not (optional and not piece["bar"]):
            found.append("'" + piece["other"] + "'")
        return f"coalesce({', '.join(found)})" if len(found) > 1 else found[0]

    return " || ".join(one(p) for p in pieces(sentence))


def _linked(links: dict[str, tuple[str, str]], keep: str = "true") -> str:
    """Business rows and the names of others by (key, column)."""
    names = "".join(f', j{i}."{column}" as "{field}"' for i, (field, (_, column)) in enumerate(links.items()))
    joins = " ".join(f'left join business_rows j{i} on j{i}.id = b."{key}"' for i, (key, _) in enumerate(links.values()))
    hidden = [f'"{field}"' for field in links if field in BUSINESS_COLUMNS]
    kept = f"b.* exclude ({', '.join(hidden)})" if hidden else "b.*"
    return f"(select {kept}{names} from (select * from business_rows where {keep}) b {joins})"


def _list(parent: str, rows: str, sentence: str, where: str, order: str = "", separator: str = ", ", distinct: str = "") -> str:
    line = f"select {distinct} {parent} as parent, {_said(sentence)} as line{', ' + order.split()[0] + ' as o' if order else ''} from {rows} where {where}"
    by = f"o{order[len(order.split()[0]):]}, line" if order else "line"
    return f"(select parent, string_agg(line, '{separator}' order by {by}) as line from ({line}) where line is not null group by 1)"


_USER = lambda field, key: {field: (key, "display_name")}
_COFOUNDER = "coalesce(role='cofounder',false) desc"
#: entity -> field -> the list it shows.
_LISTS = {
    "learnings": {"trail": _list("learning_id", _linked(_USER("actor", "actor_user_id")), "{@created_at} {event_type}« by {actor,actor_agent_id,actor_type}»« — {reason}»", "true",
                                 "created_at", "; ")},
    "people": {
        "works_on": _list("member_id", _linked({"venture": ("venture_id", "name")}, "member_type = 'human'"), "{venture}« ({role})»", "venture is not null", _COFOUNDER),
        "owned": _list("member_id", _linked({"venture": ("venture_id", "name")}, "owns <> ''"), "{owns} in {venture}", "venture is not null", "venture"),
    },
    "ventures": {
        "team": _list("venture_id", _linked(_USER("member", "member_id"), "member_type = 'human'"), "{member}« ({role})»", "member is not null", _COFOUNDER),
        "agents": _list("venture_id", _linked({"agent": ("member_id", "name")}, "member_type = 'agent'"), "{agent}", "agent is not null"),
    },
    "portfolios": {"members": _list("portfolio_id", "business_rows", "{name}", "name is not null"),
                   "alias": "(select portfolio_id as parent, alias as line from portfolio_aliases)"},
    "harvested": {"who": _list("item_id", _linked(_USER("submitter", "submitter_id")), "{submitter|someone} via {channel|-}", "true", distinct="distinct")},
    "calendar": {"attendees": _list("event_id", _linked(_USER("attendee", "user_id")), "{attendee}", "attendee is not null")},
}
_MORE = {
    "learnings": ", (select max(e.created_at) from business_rows e where e.learning_id = r.id) as last_at",
    "portfolios": ", upper(left(name, 1)) || lower(substring(name, 2)) as title_name",
    "ventures": ", upper(left(portfolio, 1)) || lower(substring(portfolio, 2)) as portfolio_title",
}


def _as_memories(name: str, rows: str) -> str:
    """Rows of ref_id, event_time, content as memories of a mapping."""
    kind, source = MAPPINGS[name]
    return rf"""select 'db:{kind}:' || cast(ref_id as varchar) as source_ref, 'studio' as namespace, '{source}' as source_kind, '{kind}' as domain_raw, event_time as valid_at,
        substring(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, {CAPS.get(name, CAP)}) as content, cast({IMPORTANCES.get(name, IMPORTANCE)} as double) as importance from ({rows})"""


def _entity(name: str) -> str:
    e, lists = ENTITIES[name], _LISTS.get(name, {})
    shown = "".join(f', l{i}.line as "{field}"' for i, field in enumerate(lists))
    joins = " ".join(f"left join {text} l{i} on l{i}.parent = r.id" for i, text in enumerate(lists.values()))
    base = _linked({field: (key, column) for field, (_, key, column) in e.links.items()}, e.keep or "true")
    times = ", ".join("timestamp '2024-01-15 12:00:00'" if c == "now" else c for c in e.times)
    rows = f'select *, coalesce({times}) as "at" from (select r.*{shown}{_MORE.get(name, "")} from {base} r {joins})'
    return _as_memories(name, f'select "{e.ref}" as ref_id, "at" as event_time, {_said(e.says)} as content from ({rows})')


SQL |= {f"mapping_{name}": _entity(name) for name in ENTITIES}


def _short(c: str, chars: int) -> str:
    return rf"substring(regexp_replace({c}, '\s+', ' ', 'g'), 1, {chars})"


def _thread(key: str, rows: str, sentence: str, k: int) -> str:
    return f"""(select {key} as parent, count(*) as n, min(created_at) as first_at, max(created_at) as last_at, sum(chars) as substance, string_agg(line, ' | ' order by r desc) as discussion
        from (select *, row_number() over (partition by {key} order by created_at desc, line) as r from (select {key}, created_at, length(body_text) as chars, {_said(sentence)} as line from ({rows})))
        where r <= {k} and {key} is not null group by 1)"""


def _told(parent: str, rows: str, sentence: str, order: str, k: int | None = None, separator: str = " | ") -> str:
    cut = f"where r <= {k}" if k else ""
    return f"""(select parent, string_agg(line, '{separator}' order by r) as line from (select *, row_number() over (partition by parent order by {order}line) as r
        from (select *, {parent} as parent, {_said(sentence)} as line from {rows}) where line is not null) {cut} group by 1)"""


def _spoken(kind: str, agent: str, short: int, body: str, where: str, links: dict) -> str:
    spoke = f"case when {kind} = 'agent' then coalesce(agent, cast({agent} as varchar)) else person end as who, " if kind else ""
    return f"select *, {spoke}{_short(body, short)} as body_short, {body} as body_text from {_linked(links, where)}"


_V = {"venture": ("venture_id", "name")}
_PERSON = lambda key: {"person": (key, "display_name")}
_COMMENTS = _thread(
    "issue_id", _spoken("author_kind", "as_agent_id", 500, "body_md", "length(body_md) >= 10", _PERSON("author_user_id") | {"agent": ("as_agent_id", "name")}),
    "[{@created_at} {who|someone}] {body_short}", 8,
)
_REPLIES = _thread(
    "target_id", _spoken("", "", 400, "body_md", "target_type = 'post' and body_md <> ''", _PERSON("author_id")), "[{@created_at} {person,as_agent_id|someone}] {body_short}", 10
)
_CHAT = _thread(
    "chat_id", _spoken("sender_kind", "sender_agent_id", 400, "body", f"body <> '' and deleted_at is null and not regexp_matches(body, '{CREDENTIAL}')",
                       _PERSON("sender_id") | {"agent": ("sender_agent_id", "name")}), "{who|someone}: {body_short}", 30,
)
_PRESENT = _list("chat_id", _linked(_PERSON("user_id") | {"agent": ("member_agent_id", "name")}), "{person,agent|unknown}", "true", distinct="distinct")
_FEATURES = f"""(select b.* exclude (state), {_short("description", 220)} as about, case when enabled then 'ON' else 'OFF' end
    || case when kill_switch then ', KILL SWITCH ENGAGED' else '' end as state from business_rows b left join feature_flags f on f.key = b.flag_key where name is not null)"""
_SOURCES = f"(select *, nullif(tags, '') as tagged, {_short('note', 150)} as noted, case when confirmed then ' [confirmed]' else '' end as mark from business_rows)"
_DIGESTS = {
    "issue_threads": ("id", "last_at", f"""select r.*, t.* exclude (parent), h.line as trail, l.line as links from {_linked(_V | {"assignee": ("assignee_id", "display_name")})} r
        join {_COMMENTS} t on t.parent = r.id left join {_told("issue_id", "business_rows", "{from_status|new}->{to_status} ({@changed_at})", "changed_at nulls first, ", None, ", ")} h on h.parent = r.id
        left join {_told("from_issue_id", "(select a.*, b.number as other from business_rows a join business_rows b on b.id = a.to_issue_id)", "{type} #{other}", "", None, ", ")} l
        on l.parent = r.id""",
        "Issue discussion thread — Issue #{number}« in venture {venture}»: {title}. Issue status: {status|-}, type {type|-}, assignee {assignee|unassigned}. "
        "{n} substantive comment(s) from {@first_at} to {@last_at}.« Status lifecycle: {trail}.»« Linked issues: {links}.» Discussion: {discussion}"),
    "post_threads": ("id", "last_at", f"select * from {_linked(_V | {'author_name': ('author_id', 'display_name')})} r join {_REPLIES} t on t.parent = r.id",
        'Post discussion — comments on the post "{title||(untitled)}" ({type|status} posted {@created_at}« by {author_name}»« in venture {venture}»): {n} comment(s) up to {@last_at}. {discussion}'),
    "chat_threads": ("id", "last_at", f"""select *, p.line as present from {_linked(_V, "coalesce(scope, '') <> 'direct'")} r join {_CHAT} t on t.parent = r.id
        left join {_PRESENT} p on p.parent = r.id where substance >= 12""",
        'Chat conversation ({scope|-}« — venture {venture}») titled "{title|(untitled)}": {n} message(s) from {@first_at} to {@last_at}. Participants: {present|unknown}. '
        "Transcript (original language preserved): {discussion}"),
    "pulse_anonymous": ("id", "moment", f"""select *, coalesce(anonymous_revealed_at, closes_at, updated_at) as moment, m.line as told from business_rows r
        join (select campaign_id as c, count(*) as n from business_rows where length(body) >= 7 group by 1) q on q.c = r.id
        join {_told("campaign_id", f"(select *, {_short('body', 700)} as b from business_rows where length(body) >= 7)", "{b}", "")} m on m.parent = r.id""",
        'Team Pulse — ANONYMOUS messages from the team, survey "{title_en|(untitled)}"« / {title_ar}»«, revealed {@anonymous_revealed_at}» '
        "({n} message(s), names withheld, in the language they were written in): {told}"),
    "deployments": ("venture_id", "last_at", f"""select e.*, v.name as venture, d.line as recent from (select venture_id, count(*) as n, min(created_at) as first_at, max(created_at) as last_at,
          count(*) filter (status = 'success') as ok, count(*) filter (status = 'failed') as failed, string_agg(distinct provider, ', ' order by provider) as providers,
          string_agg(distinct env, ', ' order by env) as places from business_rows where venture_id is not null group by 1) e left join business_rows v on v.id = e.venture_id
        left join {_told("venture_id", f"(select *, substring(sha, 1, 7) as s, {_short('commit_message', 90)} as m from business_rows)",
                         '{@created_at} {status|-} {s}« "{m}"»« by {author}»', "created_at desc, ", 12)} d on d.parent = e.venture_id""",
        "Deployment history — venture {venture,venture_id}: {n} deployment events between {@first_at} and {@last_at}. Succeeded: {ok}, failed: {failed}. "
        "Providers: {providers|-}. Environments: {places|-}. Recent deploys: {recent|-}"),
    "feature_catalog": ("phase", "last_at", f"""select * from (select coalesce(lifecycle, 'unspecified') as phase, count(*) as n, max(coalesce(updated_at, created_at)) as last_at from business_rows group by 1) r
        left join {_told("coalesce(lifecycle, 'unspecified')", _FEATURES, "{name}« / {name_ar}»« at route {route}»« [flag {flag_key} = {state}]»«: {about}»", "name, ")} t on t.parent = r.phase""",
        "feature catalogue — {phase} features ({n} of them): {line}"),
    "harvest_sources": ("source_type", "last_at", f"""select * from (select source_type, count(*) as n, max(coalesce(updated_at, created_at)) as last_at from business_rows
          where source_type is not null group by 1) r left join {_told("source_type", _SOURCES, "{title,url||}« ({tagged})»« — {noted}»{mark}", "title nulls last, ")} t on t.parent = r.source_type""",
        "Harvester sources — {n} {source_type} source(s) of the harvest: {line}"),
    "curator_backlog": ("all", "last_at", f"""select 'all' as "all", count(*) as n, max(created_at) as last_at,
        (select string_agg(x, ', ' order by x) from (select distinct proposal_type || '/' || status as x from business_rows)) as kinds,
        (select string_agg(x, ', ' order by x) from (select proposal_type || ' ' || status || ' x' || count(*) as x from business_rows group by proposal_type, status)) as counted,
        (select line from {_told("1", f"(select created_at, {_short('reason', 260)} as because from business_rows where reason <> '')", "{because}", "created_at desc, ", 8)}) as reasons from business_rows""",
        "Learnings curator backlog as of {@last_at}: {n} curator proposals — {kinds}. Counts: {counted}. Sample reasons the curator gave: {reasons|-}"),
    "playbook_progress": ("all", "last_at", f"""select 'all' as "all", count(*) as n, max(updated_at) as last_at, (select line from {_told("1",
        f"(select *, coalesce(len(completed_step_ids), 0) as steps, array_to_string(completed_step_ids, ', ') as ids from {_linked(_PERSON('user_id'))})",
        "{person|someone} completed {steps} step(s) ({ids|none})", "steps desc, ")}) as told from business_rows""",
        "Playbook (onboarding) progress as of {@last_at}: {n} people have progress recorded. {told}"),
}
_DIGEST = "concat_ws('|', cast(agent_id as varchar), coalesce(cast(venture_id as varchar), 'none'), strftime(created_at, '%G-W%V'))"
_ACTS = f"(select *, {_DIGEST} as digest, cast(date_trunc('week', created_at) as date) as week from business_rows where agent_id is not null)"
_HOURS = "cast(round(median(epoch({} - created_at) / 3600.0), 1) as decimal(18, 1))"
_ENDED = "(select *, case when merged_at is not null then 'merged ' || strftime(merged_at, '%Y-%m-%d') else state || ' since ' || strftime(created_at, '%Y-%m-%d') end as ended from business_rows)"
_DIGESTS |= {
    "agent_activity": ("digest", "last_at", f"""select r.*, v.name as venture, a.name as agent, b.line as breakdown, s.line as notable, case when v.name is null then 'the studio (no venture)' else 'venture ' || v.name end as place
        from (select digest, week, agent_id, venture_id, count(*) as n, max(created_at) as last_at, count(*) as runs, count(*) filter (status = 'failed') as failed from {_ACTS} group by all) r
        left join {_told("digest", f"(select digest, kind, count(*) as n from {_ACTS} where kind is not null group by all)", "{kind} x{n}", "n desc, ", None, ", ")} b on b.parent = r.digest
        left join {_told("digest", f"(select * from {_ACTS} where summary <> '' qualify row_number() over (partition by digest, substring(summary, 1, 45) order by created_at desc, summary desc) = 1)",
                         "{summary}", "created_at desc, ", 25)} s on s.parent = r.digest
        left join business_rows v on v.id = r.venture_id left join business_rows a on a.id = r.agent_id""",
        "Agent activity digest — agent {agent,agent_id} on {place} for the week of {@week}: {n} recorded actions. Breakdown by kind: {breakdown}."
        "« {runs} agent run(s), {failed} failed.»« Newest first: {notable}»"),
    "github_pr_activity": ("repo_full_name", "last_at", f"""select r.*, w.line as who, t.line as recent from (select repo_full_name, org_slug, count(*) as n, min(created_at) as first_at,
          max(created_at) as newest_at, max(greatest(created_at, merged_at, closed_at)) as last_at, count(merged_at) as merged, count(*) filter (state = 'open') as open,
          count(*) filter (merged_at is null and state <> 'open') as dropped, {_HOURS.format("first_review_at")} as to_review, {_HOURS.format("merged_at")} as to_merge
          from business_rows where repo_full_name is not null group by all) r
        left join {_told("repo_full_name", "(select repo_full_name, author_login, count(*) as n from business_rows where author_login is not null group by all)", "{author_login} ({n})", "n desc, ", 8, ", ")} w
        on w.parent = r.repo_full_name left join {_told("repo_full_name", f"(select * from {_ENDED} where ended is not null)", "#{number} by {author_login|?} {ended}", "created_at desc, ", 10, ", ")} t
        on t.parent = r.repo_full_name""",
        "GitHub pull-request activity — repository {repo_full_name} (org {org_slug|-}): {n} pull requests tracked between {@first_at} and {@newest_at}. Merged: {merged}, "
        "still open: {open}, closed without merging: {dropped}. Median hours to first review: {to_review|never reviewed}. Median hours open before merge: {to_merge|-}. "
        "Authors: {who|-}. Most recent pull requests: {recent|-}"),
}
_ANSWERS = """(select q.campaign_id, q."key", json_extract_string(a."value", '$.text') as answer, coalesce(json_extract_string(a."value", '$.choice'), json_extract_string(a."value", '$.value')) as choice,
    r.submitted_at, r.campaign_id as response_to from business_rows a join business_rows q on q.id = a.question_id left join business_rows r on r.id = a.response_id where q."key" is not null)"""
_GIVEN = f"(select *, {_short('answer', 220)} as short from {_ANSWERS} where length(answer) >= 12 and campaign_id = response_to)"
_DIGESTS["pulse_surveys"] = ("id", "moment", f"""select c.*, n, asked.line as asked, told.line as told, made.line as made, unsigned.line as unsigned,
      coalesce(anonymous_revealed_at, last_at, closes_at, updated_at, created_at) as moment from business_rows c
    join (select campaign_id as r, count(*) as n, max(submitted_at) as last_at from business_rows where campaign_id is not null group by 1) on r = c.id
    left join {_told("campaign_id", "(select * from business_rows where prompt_en is not null)", "{prompt_en}« / {prompt_ar}»", "sort_order, ", None, "; ")} asked on asked.parent = c.id
    left join {_told("campaign_id", _GIVEN, "[{key}] {short}", "submitted_at desc nulls last, ", 24)} told on told.parent = c.id
    left join {_told("campaign_id", f"(select campaign_id, key, choice, count(*) as times from {_ANSWERS} where choice is not null group by all)", "{key}: {choice} x{times}", "key, times desc, ", None, ", ")} made
    on made.parent = c.id left join {_told("campaign_id", f"(select *, {_short('body', 500)} as b from business_rows where length(body) >= 7)", "{b}", "")} unsigned on unsigned.parent = c.id""",
    'Team Pulse survey "{title_en|(untitled)}"« / {title_ar}» — status {status|-}«, opened {@opens_at}»«, closes {@closes_at}». Responses: {n}. {intro_en} {intro_ar}'
    "« Questions asked: {asked}.»« Free-text answers from the team (verbatim): {told}»« Scale/choice results: {made}»"
    "« Anonymous messages to the company (verbatim): {unsigned}»")  # fmt: skip
for _name, (_ref, _at, _rows, _sentence) in _DIGESTS.items():
    SQL[f"mapping_{_name}"] = _as_memories(_name, f'select "{_ref}" as ref_id, "{_at}" as event_time, {_said(_sentence)} as content from ({_rows})')


# One write after the other: a row per write, with the ids that were added and retired so far.
_IN_ORDER = f"""with recursive live as (select *, cast(regexp_extract(id, '([0-9]+)$', 1) as bigint) as k from memories where {_LIVE}),
    batch as (select *, row_number() over (order by seq) as o from (select v * 1000000000 + k as seq, 'w' || v || '-' || id as id, namespace, case when v > 1 and k % 3 = 0 then source_ref end as source_ref,
        case when v < 2 then content || ' more' when v = 2 then 'no longer ' || content else content end as content, valid_at,
        list_transform(embedding::double[], lambda x, i: x + case when i = 1 then (case when v < 2 then 0.3 when v = 2 then 0.1 else 0 end)::double else 0 end) as embedding
        from live, range(4) t(v) where embedding is not null and k % 25 = 0)),
    known as (select 0 as o, id, namespace, source_ref, content, embedding::double[] as embedding, valid_at from live union all select o, id, namespace, source_ref, content, embedding, valid_at from batch),
    near as materialized (select b.o, m.o as top_o, m.id as top, m.valid_at, round({_cosine("b.embedding", "m.embedding")}, 6) as similarity, {_NORM.format("b.content")} = {_NORM.format("m.content")} as same
        from batch b join known m on m.namespace = b.namespace and m.o < b.o where b.source_ref is null and m.embedding is not null),
    named as materialized (select b.o, m.o as top_o, m.id as top, m.valid_at from batch b join known m on m.namespace = b.namespace and m.source_ref = b.source_ref and m.o < b.o),
    said as (select o, id, source_ref, {" or ".join(f"contains(lower(content), '{c}')" for c in _CUES)} as denies from batch),
    step as (
      select 0::bigint as o, null::varchar as id, null::varchar as decision, null::varchar as target_id, []::bigint[] as added, []::varchar[] as gone
      union all
      select o, id, decision, case when decision <> 'add' then top end, case when decision <> 'noop' then list_append(added, o) else added end,
             case when decision in ('update', 'invalidate') then list_append(gone, top) else gone end
      from (
        select b.o, b.id, s.added, s.gone, coalesce(n.top, t.top) as top, case when b.source_ref is not null then case when n.top is null then 'add' else 'update' end
               when t.top is null then 'add' when t.same then 'noop' when t.similarity >= 0.88 and b.denies then 'invalidate'
               when t.similarity >= 0.97 then 'noop' when t.similarity >= 0.88 then 'update' else 'add' end as decision
        from step s join said b on b.o = s.o + 1
        left join lateral (select top, similarity, same from near p where p.o = b.o and (top_o = 0 or list_contains(s.added, top_o)) and not list_contains(s.gone, top)
                           order by similarity desc, top limit 1) t on true
        left join lateral (select top from named p where p.o = b.o and (top_o = 0 or list_contains(s.added, top_o)) and not list_contains(s.gone, top)
                           order by valid_at desc, top desc limit 1) n on true)),
    decided as (select id, decision, target_id from step where o > 0)"""
SQL["write_batch_ordered"] = f"{_IN_ORDER} select * from decided"
SQL["write_batch_state"] = f"""{_IN_ORDER},
    hits as (select target_id as id, count(*) filter (decision = 'noop') as noops, max(id) filter (decision = 'update') as superseded_by,
        count(*) filter (decision in ('update', 'invalidate')) as retirements from decided where target_id is not null group by 1)
    select id, coalesce(retirements, 0) = 0 as live, superseded_by, round(least(1.0::double, importance + 0.02::double * coalesce(noops, 0)), 6) as importance
    from (select id, importance::double as importance from live union all select id, 0.4 from decided where decision <> 'noop') left join hits using (id)"""


SQL["organized_edges"] = """with m as (select * from (select id, source_ref, row_number() over (partition by source_ref order by invalid_at is null desc, valid_at desc, id desc) as r from memories) where r = 1)
    select cast(e.owner_id as varchar) as src, 'ORGANIZED' as relation, cast(e.id as varchar) as dst, e.start_at as since, coalesce(nullif(p.display_name, ''), p.email) as name, m.id as memory_id
    from business_rows e join business_rows p on p.id = e.owner_id left join m on m.source_ref = 'doc:' || e.id where p.id % 9 <> 4"""
_ACTIVITY = " union all ".join(f"select * from ({SQL[f'rollup_docs_{k}']})" for k in ("repo", "person", "ai_person", "org", "studio_ai"))
_ACTIVITY = f"""with docs as ({_ACTIVITY}), a as (select *, 'activity:' || source_ref as id, split_part(scope, ':', 1) as kind, regexp_replace(scope, '^[a-z]+:', '') as subject,
    case when split_part(source_ref, ':', 2) in ('ai', 'studio-ai') then 'AI' else 'commits' end as signal from docs)"""
SQL["rollup_activity_nodes"] = f"{_ACTIVITY} select id, subject || ' · ' || period || ' ' || signal as name, 'activity' as entity_type, subject, source_ref from a"
SQL["rollup_activity_edges"] = f"""{_ACTIVITY} select id as src, case kind when 'person' then 'ACTIVITY_OF' else 'ACTIVITY_IN' end as relation, subject as dst, valid_at as since,
    cast(coalesce(json_extract_string(metadata, '$.commits'), json_extract_string(metadata, '$.events')) as double) as weight, cast(null as varchar) as memory_id from a where kind in ('person', 'repo')"""
SQL["rollup_edges_restamped"] = """select 'e' || m.id as src, n.id as memory_id from memories m join (select source_ref, id, row_number() over (partition by source_ref order by valid_at desc, id desc) as r
    from memories where invalid_at is null) n on n.source_ref = m.source_ref and n.r = 1 where length(m.id) % 3 <> 0 and m.id <> n.id"""
SQL["ingest_best_effort"] = r"""select *, cast(sum(ingested) over (order by run) as bigint) as doc_count from (
    select case when page_id % 2 = 0 then 'r1' else 'r2' end as run, 'ok' as status, count(*) as documents, count(*) filter (good) as ingested, count(*) filter (not good) as failed
    from (select *, page_id % 10 not in (1, 2, 3) and regexp_matches(coalesce(html, ''), '\S') as good from pages) group by 1)"""
SQL |= {f"states_{new}": SQL[old] for new, old in (("dau", "v_dau"), ("wau", "v_wau"), ("dau_14d", "dau_last_14d"))}
SQL["states_pr_medians"] = f"""select week, repo_full_name, median_review_minutes, median_merge_minutes from ({SQL["v_pr_throughput_weekly"]})
    where median_review_minutes is not null or median_merge_minutes is not null"""


SQL["venture_trace"] = """with edges as (select * from entity_edges where valid_to is null union all select * from trace_edges where valid_to is null),
    known as (select id, name, entity_type from entities union all select id, name, entity_type from trace_nodes),
    root as (select id, name from known where entity_type = 'venture' and lower(name) like '%ion\\_3%' escape '\\' order by length(name), name, id limit 1),
    near as (select distinct case relation when 'BELONGS_TO' then 'portfolio' when 'REPO_OF' then 'repos' when 'MEMBER_OF' then 'members' when 'GOAL_FOR' then 'goals' when 'PLANS' then 'roadmaps'
        when 'TARGETS' then 'okrs' when 'APPLIES_TO' then 'learnings' when 'CHANNEL_OF' then 'channels' when 'MEETING_ABOUT' then 'meetings' when 'WORKS_ON' then 'agents' when 'FEED_OF' then 'feed' end as step,
        case when relation = 'BELONGS_TO' then dst_id else src_id end as node from edges, root where root.id = case when relation = 'BELONGS_TO' then src_id else dst_id end),
    first as (select step, node from near where step is not null and node in (select id from known)),
    far as (select f.step, e.relation, e.src_id, max(e.valid_from) as newest from first f join edges e on e.dst_id = f.node group by all),
    plan as (select * from (values (0, 'venture', 'portfolio', null, null), (1, 'venture', 'repos', null, null), (2, 'venture', 'members', null, null), (3, 'venture', 'goals', null, null),
        (4, 'venture', 'roadmaps', null, null), (5, 'venture', 'okrs', null, null), (6, 'venture', 'learnings', null, null), (7, 'venture', 'channels', null, null), (8, 'venture', 'meetings', null, null),
        (9, 'venture', 'agents', null, null), (10, 'venture', 'feed', null, null), (11, 'repos', 'code_modules', 'CODE_IN', null), (12, 'repos', 'docs', 'DOC_IN', null),
        (13, 'repos', 'committers', 'COMMITS_TO', null), (14, 'repos', 'repo_activity', 'ACTIVITY_IN', null), (15, 'members', 'member_activity', 'ACTIVITY_OF', null),
        (16, 'feed', 'feed_authors', 'POSTED_IN', null), (17, 'members', 'recent_activity', 'ACTIVITY_OF', timestamp '2024-02-06'), (18, 'feed', 'feed_posts', null, null)) v(place, after, step, relation, since))
    select root.name as venture, place, after, step, case
        when step = 'feed_posts' then (select count(*) from memory_entities m where replace(m.entity_id, 'n', 'feed') in (select node from first f where f.step = 'feed'))
        when relation is null then (select count(*) from first f where f.step = plan.step)
        else (select count(*) from far where far.relation = plan.relation and far.step = plan.after and (plan.since is null or far.newest > plan.since)) end as n from plan, root"""
SQL["coverage_report"] = """with recent as (select * from github_commits where day > (select max(day) from github_commits) - 90),
    lacking as (select repo_full_name as repo, count(*) as n, count(distinct author_login) as people, max(day) as last from recent
        where lower(repo_full_name) not in (select lower(repo) from repo_links where url_venture in ('v0', 'v4')) group by 1),
    ranked as (select *, row_number() over (order by n desc, repo) as r from lacking),
    found as (select count(*) as n, string_agg(repo || ' (' || format('{:,}', n) || ' commits by ' || people || ' people, last on ' || last || ')', '; ' order by r) filter (r <= 10) as told from ranked)
    select 'code:index-coverage-gap' as source_ref, case when n > 0
        then format('{:,}', n) || ' repositories with commits in the 90 days up to ' || (select max(day) from github_commits) || ' are not registered for indexing, so nothing can be said from their code. The most active: ' || told || '.'
        else 'All repositories with commits in the 90 days up to ' || (select max(day) from github_commits) || ' are registered for indexing.' end as content,
        timestamp '2024-01-15 12:00:00' as valid_at, '{"type":"code-coverage","unindexed":' || n || ',"window_days":90}' as metadata from found"""
SQL["repository_overview_documents"] = rf"""with f as (select p_brand as repo, concat('src/', lower(p_type), '/', case when p_partkey % 5 = 0 then 'handler_' else '' end, replace(p_name, ' ', '_'), '_', p_partkey, '.go') as path, lower(p_type) as language, p_size * 1000 as bytes from part),
    base as (select repo, count(*) as files, cast(sum(bytes) as bigint) as bytes from f group by 1),
    langs as (select repo, string_agg(language || ' (' || n || ')', ', ' order by r) as said from (select *, row_number() over (partition by repo order by n desc, language) as r from (select repo, language, count(*) as n from f group by 1, 2)) where r <= 8 group by 1),
    tops as (select repo, string_agg(folder || ' (' || n || ')', ', ' order by r) as said from (select *, row_number() over (partition by repo order by n desc, folder) as r from (select repo, case when contains(path, '/') then split_part(path, '/', 1) else '(root)' end as folder, count(*) as n from f group by 1, 2)) where r <= 14 group by 1),
    big as (select repo, string_agg(path || ' (' || bytes || ' bytes)', chr(10) order by r) as said from (select *, row_number() over (partition by repo order by bytes desc, path) as r from f) where r <= 12 group by 1),
    d as (select *, case when regexp_matches(lower(path), '(^|/)readme[^/]*$') then 0 when starts_with(lower(path), 'docs/') then 1 else 2 end as place from (
        select 'Brand#' || (1 + doc_id % 4) || (1 + doc_id % 3) as repo, case when doc_id % 5 = 0 then 'Docs/g' else 'pkg' end || doc_id || case when doc_id % 7 = 0 then '/ReadMe.md' when doc_id % 7 < 3 then '.md' end as path,
          chr(10) || ' # title ' || repeat(chr(10), 4) || text || ' ' || chr(10) as content from documents) where path is not null),
    numbered as (select *, row_number() over (partition by repo order by place, lower(path), path) as r from d),
    docs as (select repo, count(*) as n, string_agg(path, ', ' order by r) filter (r <= 12) as said from numbered group by 1),
    tidy as (select repo, r, nullif(substring(regexp_replace(regexp_replace(coalesce(content, ''), '^[ 	

]+|[ 	

]+$', '', 'g'), '
{{3,}}', chr(10) || chr(10), 'g'), 1, 700), '') as opening from numbered where place = 0),
    readme as (select repo, arg_min(opening, r) as opening from tidy where opening is not null group by 1),
    heads as (select p_brand as repo, sha256(p_name) as sha, cast(date '2024-01-01' + cast(p_partkey % 300 as integer) as date) as date from part where p_size > 48),
    head as (select repo, sha, date from heads qualify row_number() over (partition by repo order by date desc, sha desc) = 1)
    select 'code:' || base.repo || ':overview' as source_ref, concat_ws(chr(10) || chr(10),
        base.repo || ' has ' || format('{{:,}}', files) || ' files of code, ' || {_scaled('bytes')} || ' bytes.', 'Its head is ' || substring(sha, 1, 9) || ' of ' || date || '.',
        'Languages (files): ' || langs.said, 'Top folders (files): ' || tops.said, 'Largest files:' || chr(10) || big.said,
        'Documents: ' || docs.said || case when docs.n > 12 then ' and ' || (docs.n - 12) || ' more' else '' end, 'The README begins:' || chr(10) || readme.opening) as content,
        date as valid_at, '{{"type":"repository-overview","files":' || files || ',"documents":' || coalesce(docs.n, 0) || '}}' as metadata
    from base left join langs using (repo) left join tops using (repo) left join big using (repo) left join docs using (repo) left join readme using (repo) left join head using (repo)"""


def oracle_sql() -> dict[str, str]:
    return {name: with_adapters(text) for name, text in SQL.items()}
