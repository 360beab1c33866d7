"""Adapters: the star-schema tables reshaped into memory, graph and activity tables.

Each is one projection over files, in the SQL that Spark and DuckDB share; ``{name}`` stands for
a base table, ``{T}`` for the type of a timestamp without zone and ``{J}`` for the JSON accessor,
the only two places where the dialects differ.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

_DAY0 = "timestamp '2024-01-01 00:00:00'"

ADAPTERS = {
    "memories": f"""
        select concat('m', cast(d.doc_id as varchar(20))) id, d.lang namespace, d.source source_kind,
               concat('doc:', cast(cast(floor(d.doc_id / 2.0) as bigint) as varchar(20))) source_ref,
               d.text content, e.embedding embedding, cast(0.1 + 0.08 * (d.doc_id % 11) as double) importance,
               cast({_DAY0} + (d.doc_id % 720) * interval '1' hour as {{T}}) valid_at,
               cast(case when d.doc_id % 7 = 0 then {_DAY0} + (d.doc_id % 720 + 240) * interval '1' hour end as {{T}}) invalid_at,
               case when d.doc_id % 11 = 0 then 'cold' else 'hot' end tier,
               case d.doc_id % 6 when 0 then 'post' when 1 then 'venture' when 2 then 'issue' when 3 then 'doc'
                    when 4 then 'playbook' else '' end domain_raw,
               case when d.doc_id % 40 = 7 then concat('no "json" ', cast(d.doc_id as varchar(20))) when d.doc_id % 40 = 8 then null when d.doc_id % 40 = 9 then '[1,"a"]' else
               concat('{{{{"lang":"', d.lang, '","kind":"', d.source, '"', case when d.doc_id % 3 = 0 then concat(',"n":', cast(d.doc_id as varchar(20)), ',"tags":["a","b"],"ok":true') else '' end,
                      case when d.doc_id % 4 = 0 then ',"o":{{{{"x":null,"y":[1.5,{{{{}}}}]}}}},"none":null' else '' end, case when d.doc_id % 10 = 4 then ',"n":-1,"lang":7' else '' end, case when d.doc_id % 5 = 0 then ',"forget_reason":"old"' else '' end,
                      case when d.doc_id % 9 = 0 then concat(',"slug":"s-', cast(d.doc_id as varchar(20)), '"') else '' end, '}}}}') end metadata,
               case when d.doc_id % 4 > 0 then concat('a', cast(d.doc_id % 13 as varchar(20))) end owner_agent_id
        from (select *, doc_id % (select count(*) from {{embeddings}}) as vec from {{documents}}) d
        left join {{embeddings}} e on e.vec_id = d.vec""",
    "memory_entities": """
        select concat('m', cast(doc_id as varchar(20))) memory_id, concat('n', cast(doc_id % 25 as varchar(20))) entity_id
        from {documents}
        union all
        select concat('m', cast(doc_id as varchar(20))), concat('c', cast(doc_id % 150 as varchar(20))) from {documents}""",
    "memory_events": """
        select event_id id, ts, case user_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end namespace,
               case event_type when 'view' then 'recall' when 'click' then 'search' when 'signup' then 'retain'
                    when 'purchase' then 'share' else 'forget' end op,
               concat('a', cast(user_id as varchar(20))) agent_id, cast(floor(value) as int) latency_ms,
               case when value < 5 then 'empty' else 'hit' end outcome,
               concat('q', cast(event_id % 40 as varchar(20))) query
        from {events}""",
    "entities": """
        select concat('r', cast(r_regionkey as varchar(20))) id, r_name name, 'portfolio' entity_type from {region}
        union all select concat('n', cast(n_nationkey as varchar(20))), n_name, 'venture' from {nation}
        union all select concat('c', cast(c_custkey as varchar(20))), c_name, 'person' from {customer}
        union all select concat('s', cast(s_suppkey as varchar(20))), s_name, 'agent' from {supplier}
        union all select distinct p_brand, p_brand, 'repo' from {part}""",
    "entity_edges": f"""
        select src_id, dst_id, relation, cast({_DAY0} + (k % 60) * interval '1' day as {{T}}) valid_from,
               cast(case when k % 5 = 0 then {_DAY0} + (k % 60 + 45) * interval '1' day end as {{T}}) valid_to
        from (
          select concat('n', cast(n_nationkey as varchar(20))) src_id, concat('r', cast(n_regionkey as varchar(20))) dst_id,
                 'BELONGS_TO' relation, cast(n_nationkey as bigint) k from {{nation}}
          union all select concat('c', cast(c_custkey as varchar(20))), concat('n', cast(c_nationkey as varchar(20))),
                 'MEMBER_OF', c_custkey from {{customer}}
          union all select concat('s', cast(s_suppkey as varchar(20))), concat('n', cast(s_nationkey as varchar(20))),
                 'WORKS_ON', s_suppkey from {{supplier}}
          union all select distinct concat('s', cast(l.l_suppkey as varchar(20))), p.p_brand, 'COMMITS_TO', l.l_suppkey
                 from {{lineitem}} l join {{part}} p on p.p_partkey = l.l_partkey where l.l_quantity >= 49
        ) e""",
    "trace_nodes": """
        select concat('feed', cast(n_nationkey as varchar(20))) id, concat('feed of ', n_name) name, 'feed' entity_type from {nation}
        union all select concat('goal', cast(s_suppkey as varchar(20))), 'goal', 'goal' from {supplier} where s_suppkey % 2 = 0""",
    "trace_edges": f"""
        select src_id, dst_id, relation, cast({_DAY0} + (k % 60) * interval '1' day as {{T}}) valid_from,
               cast(case when k % 7 = 0 then {_DAY0} + (k % 60 + 45) * interval '1' day end as {{T}}) valid_to
        from (
          select p_brand src_id, concat('n', cast(p_partkey % 25 as varchar(20))) dst_id, 'REPO_OF' relation, p_partkey k from {{part}}
          union all select concat('mod', cast(p_partkey as varchar(20))), p_brand, 'CODE_IN', p_partkey from {{part}}
          union all select concat('file', cast(p_size as varchar(20))), p_brand, 'DOC_IN', p_partkey from {{part}} where p_size < 20
          union all select concat('week', cast(p_partkey % 30 as varchar(20)), p_brand), p_brand, 'ACTIVITY_IN', p_partkey from {{part}}
          union all select concat('act', cast(o_orderkey as varchar(20))), concat('c', cast(o_custkey as varchar(20))), 'ACTIVITY_OF', o_orderkey from {{orders}}
          union all select concat('goal', cast(s_suppkey as varchar(20))), concat('n', cast(s_nationkey as varchar(20))), 'GOAL_FOR', s_suppkey from {{supplier}}
          union all select concat('feed', cast(n_nationkey as varchar(20))), concat('n', cast(n_nationkey as varchar(20))), 'FEED_OF', n_nationkey + 1 from {{nation}}
          union all select concat('c', cast(c_custkey as varchar(20))), concat('feed', cast(c_nationkey as varchar(20))), 'POSTED_IN', c_custkey from {{customer}}
        ) e""",
    "feature_events": """
        select event_id id, concat('f', {J}) feature_key, event_type event, user_id, ts created_at,
               concat(cast(user_id as varchar(20)), '-', cast(cast(ts as date) as varchar(20))) session_id,
               concat('v', cast(user_id % 25 as varchar(20))) venture_id, concat('/', event_type) path,
               cast(floor(value * 1000) as bigint) engagement_ms
        from {events}""",
    "transition_events": """
        select event_id id, user_id, ts created_at, event_type event,
               concat(cast(user_id as varchar(20)), '-', cast(cast(ts as date) as varchar(20))) session_id
        from {events} where event_type in ('view', 'error')""",
    "github_commits": """
        select p.p_brand repo_full_name, concat('org', cast(l.l_suppkey % 5 as varchar(20))) org_slug,
               concat('login', cast(l.l_suppkey as varchar(20))) author_login, cast(l.l_shipdate as date) as day,
               l.l_linenumber + 8 as commit_hour, cast(l.l_quantity as bigint) additions,
               cast(floor(l.l_tax * 100) as bigint) deletions
        from {lineitem} l join {part} p on p.p_partkey = l.l_partkey""",
    "github_pull_requests": """
        select o.o_orderkey id,
               concat('org', cast(o.o_custkey % 5 as varchar(20)), '/repo', cast(o.o_custkey % 40 as varchar(20))) repo_full_name,
               o.o_orderdate created_at, min(l.l_shipdate) first_review_at,
               case when o.o_orderstatus = 'F' then max(l.l_shipdate) end merged_at
        from {orders} o left join {lineitem} l on l.l_orderkey = o.o_orderkey
        group by o.o_orderkey, o.o_custkey, o.o_orderdate, o.o_orderstatus""",
    "claude_activity_events": """
        select event_id id, case when event_type = 'click' then 'prompt' when event_type = 'view' then 'turn' else 'tool' end event_type,
               case when user_id % 5 = 0 then 'agent' else 'human' end actor_kind, user_id,
               concat('a', cast(user_id % 7 as varchar(20))) agent_id,
               concat(cast(user_id as varchar(20)), '-', cast(cast(ts as date) as varchar(20))) session_id, ts created_at,
               cast(floor(value) as bigint) input_tokens, cast(floor(value * 2) as bigint) output_tokens,
               cast(floor(value * 30) as bigint) cache_read_tokens, cast(floor(value * 3) as bigint) cache_creation_tokens,
               cast(floor(value) + floor(value * 2) + floor(value * 30) + floor(value * 3) as bigint) total_tokens,
               case when user_id % 50 = 0 then '/home/u/Brand#13' end cwd
        from {events}""",
    "agent_actions": """
        select event_id id, concat('a', cast(user_id % 7 as varchar(20))) agent_id,
               concat('v', cast(user_id % 25 as varchar(20))) venture_id,
               case when value > 100 then 'schedule' else 'manual' end trigger_kind, event_type kind, ts created_at,
               concat(event_type, ' by a', cast(user_id % 7 as varchar(20)), ' #', cast(event_id % 9 as varchar(20))) summary
        from {events} where event_type in ('purchase', 'signup')""",
    "issue_activity": """
        select event_id id, event_id % 200 issue_id, event_type action,
               case when user_id % 5 = 0 then 'agent' else 'human' end actor_kind, ts created_at
        from {events} where event_type in ('error', 'signup')""",
    "notifications": """
        select event_id id, user_id recipient_id, event_type kind, ts created_at,
               case when value > 50 then ts + interval '10' minute end read_at
        from {events}""",
    "dim_ventures": """
        select concat('v', cast(n_nationkey as varchar(20))) id, n_name name,
               concat('r', cast(n_regionkey as varchar(20))) portfolio_id from {nation}""",
    "dim_users": """
        select c_custkey id, c_name display_name, c_mktsegment team from {customer}""",
    "user_people": """
        select distinct user_id, concat('person', cast(user_id % 40 as varchar(20))) person from {events}""",
    "people": """
        select concat('login', cast(s_suppkey as varchar(20))) login,
               concat('person', cast(s_suppkey % 40 as varchar(20))) person, s_suppkey % 150 user_id from {supplier}""",
    "declared_types": """
        select 'portfolio' name union all select 'venture' union all select 'person' union all select 'agent'
        union all select 'meeting'""",
    "declared_relations": """
        select 'BELONGS_TO' name, 'venture' src_type, 'portfolio' dst_type union all select 'MEMBER_OF', 'person', null
        union all select 'OWNS', 'person', 'venture'""",
    "grants": """
        select 'a1' agent_id, 'en' namespace, true can_read, true can_write
        union all select 'a1', 'fr', true, false union all select 'a1', 'de', false, true
        union all select 'a2', 'es', true, false""",
    "repo_links": """
        select distinct p.p_brand repo, concat('org', cast(p.p_partkey % 5 as varchar(20))) org,
               case when p.p_partkey % 4 = 0 then concat('v', cast(p.p_partkey % 25 as varchar(20))) end url_venture
        from {part} p""",
    "ventures": "select id, portfolio_id from (select concat('v', cast(n_nationkey as varchar(20))) id, concat('r', cast(n_regionkey as varchar(20))) portfolio_id from {nation}) t",
    "venture_members": """
        select c_custkey id, concat('v', cast(c_nationkey as varchar(20))) venture_id, case when c_custkey % 4 > 0 then concat('c', cast(c_custkey as varchar(20))) end user_id,
               case when c_custkey % 4 = 0 then concat('a', cast(c_custkey % 7 as varchar(20))) end agent_id from {customer}""",
    "venture_responsibilities": "select s_suppkey id, concat('p', cast(s_suppkey as varchar(20))) owner_id, concat('v', cast(s_nationkey as varchar(20))) venture_id from {supplier}",
    "issues": """
        select o_orderkey id, concat('i', cast(o_orderkey as varchar(20))) issue_id, concat('v', cast(o_custkey % 25 as varchar(20))) venture_id,
               case when o_orderstatus <> 'F' then concat('c', cast(o_custkey as varchar(20))) end assignee_id from {orders}""",
    "posts": """
        select event_id id, concat('c', cast(user_id as varchar(20))) author_id, case when user_id % 3 > 0 then concat('v', cast(user_id % 25 as varchar(20))) end venture_id
        from {events} where event_type = 'view'""",
    "venture_dependencies": """
        select n_nationkey id, concat('v', cast(n_nationkey as varchar(20))) venture_id, concat('v', cast((n_nationkey + 7) % 25 as varchar(20))) depends_on_id from {nation}""",
    "bd_deals": """
        select o_orderkey id, concat('c', cast(o_custkey as varchar(20))) owner_id, concat('v', cast(o_orderkey % 25 as varchar(20))) venture_id from {orders} where o_orderstatus = 'O'""",
    "harvester_items": """
        select doc_id id, case when doc_id % 5 > 0 then concat('a', cast(doc_id % 7 as varchar(20))) end agent_id, concat('v', cast(doc_id % 25 as varchar(20))) venture_id from {documents}""",
    "issue_learnings": """
        select p_partkey id, concat('l', cast(p_partkey as varchar(20))) learning_id, concat('v', cast(p_size % 25 as varchar(20))) venture_id,
               case when p_partkey % 2 = 0 then concat('c', cast(p_partkey % 150 as varchar(20))) end author_id from {part}""",
    "user_goals": "select c_custkey id, concat('c', cast(c_custkey as varchar(20))) user_id, concat('g', cast(c_custkey as varchar(20))) goal_id from {customer}",
    "venture_goals": "select n_nationkey id, concat('vg', cast(n_nationkey as varchar(20))) goal_id, concat('v', cast(n_nationkey as varchar(20))) venture_id from {nation}",
    "roadmaps": "select n_nationkey id, concat('rm', cast(n_nationkey as varchar(20))) roadmap_id, concat('v', cast(n_nationkey as varchar(20))) venture_id from {nation}",
    "venture_okr_snapshots": "select s_suppkey id, concat('ok', cast(s_suppkey as varchar(20))) okr_id, concat('v', cast(s_nationkey as varchar(20))) venture_id from {supplier}",
    "venture_okr_targets": "select n_nationkey id, concat('ot', cast(n_nationkey as varchar(20))) okr_id, concat('v', cast(n_nationkey as varchar(20))) venture_id from {nation}",
    "marketing_campaigns": """
        select p_partkey id, concat('mc', cast(p_partkey as varchar(20))) campaign_id, concat('v', cast(p_partkey % 25 as varchar(20))) venture_id,
               concat('c', cast(p_partkey % 150 as varchar(20))) owner_id from {part}""",
    "channels": "select n_nationkey id, concat('ch', cast(n_nationkey as varchar(20))) channel_id, concat('v', cast(n_nationkey as varchar(20))) venture_id from {nation}",
    "calendar_events": """
        select distinct cast(floor(event_id / 4) as bigint) id, concat('mt', cast(cast(floor(event_id / 4) as bigint) as varchar(20))) meeting_id,
               concat('v', cast(cast(floor(event_id / 4) as bigint) % 25 as varchar(20))) venture_id from {events}""",
    "calendar_event_attendees": """
        select cast(floor(event_id / 4) as bigint) id, concat('c', cast(user_id as varchar(20))) user_id,
               concat('mt', cast(cast(floor(event_id / 4) as bigint) as varchar(20))) meeting_id from {events}""",
    "issue_comments": """
        select l_orderkey id, concat('i', cast(l_orderkey as varchar(20))) issue_id, case when l_suppkey % 3 > 0 then concat('p', cast(l_suppkey as varchar(20))) end author_id,
               case when l_suppkey % 3 = 0 then concat('a', cast(l_suppkey % 7 as varchar(20))) end agent_id from {lineitem}""",
    "pull_authors": """
        select o_orderkey id, concat('c', cast(o_custkey as varchar(20))) user_id,
               concat('org', cast(o_custkey % 5 as varchar(20)), '/repo', cast(o_custkey % 40 as varchar(20))) repo_full_name from {orders}""",
    "repositories": """
        select distinct concat('org', cast(p_partkey % 8 as varchar(20)), '/',
               case when p_partkey % 4 = 0 then concat('Nation-', cast(p_partkey % 40 as varchar(20))) else lower(replace(p_brand, '#', '-')) end) repo
        from {part}""",
    "venture_sites": """
        select concat('v', cast(n_nationkey as varchar(20))) id, n_name name,
               case when n_nationkey % 5 = 0 then concat('https://github.com/Org', cast(n_nationkey % 8 as varchar(20)), '/brand-', cast(n_nationkey + 11 as varchar(20)), '.git')
                    when n_nationkey % 5 = 1 then concat('git@github.com:org', cast(n_nationkey % 8 as varchar(20)), '/nation-', cast(n_nationkey as varchar(20)), '?tab=code') end url
        from {nation}""",
    "organisations": """
        select concat('org', cast(r_regionkey as varchar(20))) org, case when r_regionkey = 1 then 'v7' when r_regionkey = 2 then 'gone' end venture_id,
               case when r_regionkey < 4 then concat('r', cast(r_regionkey as varchar(20))) end portfolio_id from {region}""",
}

# Columns of ``business_rows``, a table with the columns of every business entity: keys of other rows, times, texts.
_KEYS = """venture_id author_id assignee_id user_id owner_id member_id owner_user_id author_user_id portfolio_id from_venture_id to_venture_id actor_user_id submitter_id
    learning_id item_id event_id issue_id post_id chat_id campaign_id to_issue_id from_issue_id target_id as_agent_id sender_id sender_agent_id member_agent_id agent_id""".split()
_TIMES = """closed_at set_at deadline_at resolved_at period_start period_end updated_at decided_at offboarded_at deleted_at starts_at ends_at publish_at recorded_at occurred_at
    won_at next_action_due_at start_at end_at backend_created_at first_seen_at fetched_at published_at computed_at raised_date archived_at anonymous_revealed_at closes_at changed_at merged_at first_review_at submitted_at opens_at""".split()
_TEXTS = """type title body_md status priority area description resolution_note scope classification body cadence focus blocked notes version display_name email slug position is_admin
    account_type github_usernames name stage kind on_hold tagline north_star website_url context decision url why_it_matters summary name_ar domain model health headline channel
    budget owns period_kind period_label rag confidence project_pct new_clients what_happened blocker quarter target_clients metric_key value label amount relation pipeline_stage
    source_category source_detail next_action lost_reason lean_canvas location provider report_md level_code intent score reason human_id owner note recommendation category key
    task_prefix visibility source registry_year description_ar role member_type event_type actor_agent_id actor_type lifecycle route flag_key source_type tags env sha
    commit_message proposal_type from_status to_status author author_kind sender_kind target_type title_en title_ar state org_slug author_login repo_full_name prompt_en prompt_ar intro_en intro_ar""".split()
_SPECIAL = {
    "member_type": "case when c_custkey % 3 = 0 then 'agent' else 'human' end",
    "role": "case when c_custkey % 7 = 0 then null when c_custkey % 5 = 0 then 'cofounder' else 'member' end",
    "status": "case c_custkey % 5 when 0 then 'rejected' when 1 then null when 2 then 'open' when 3 then 'failed' else 'success' end",
    "lean_canvas": "case when c_custkey % 3 = 0 then '{{}}' when c_custkey % 3 = 1 then concat('{{\"problem\":\"p', cast(c_custkey as varchar(20)), '\"}}') end",
    "lifecycle": "case c_custkey % 4 when 0 then 'beta' when 1 then 'stable' when 2 then 'retired' end",
    "source_type": "case c_custkey % 4 when 0 then 'rss' when 1 then 'site' when 2 then 'channel' end",
    "proposal_type": "case c_custkey % 3 when 0 then 'merge' when 1 then 'retag' end",
    "env": "case c_custkey % 3 when 0 then 'staging' when 1 then 'production' end",
    "author_kind": "case when c_custkey % 3 = 0 then 'agent' else 'human' end",
    "sender_kind": "case when c_custkey % 4 = 0 then 'agent' else 'human' end",
    "target_type": "case when c_custkey % 4 = 1 then 'issue' else 'post' end",
    "scope": "case c_custkey % 4 when 0 then 'direct' when 1 then 'venture' when 2 then 'team' end",
    "kind": "case c_custkey % 4 when 0 then 'deploy' when 1 then 'review' when 2 then 'plan' end",
    "state": "case when c_custkey % 3 = 0 then 'open' else 'closed' end",
    "org_slug": "case when c_custkey % 6 > 1 then concat('org', cast(c_custkey % 6 % 4 as varchar(20))) end",
    "repo_full_name": "case when c_custkey % 11 > 0 then concat('org', cast(c_custkey % 6 as varchar(20)), '/repo') end",
    "author_login": "case when c_custkey % 5 > 0 then concat('login', cast(c_custkey % 23 as varchar(20))) end",
    "value": "case c_custkey % 4 when 0 then concat('{{\"text\":\"a longer  answer ', cast(c_custkey % 60 as varchar(20)), '\"}}') when 1 then concat('{{\"choice\":\"c', cast(c_custkey % 3 as varchar(20)), '\"}}') when 2 then '{{\"value\":\"5\"}}' end",
    "key": "case when c_custkey % 7 > 0 then concat('q', cast(c_custkey % 3 as varchar(20))) end",
    "flag_key": "case when c_custkey % 3 > 0 then concat('flag', cast(c_custkey % 40 as varchar(20))) end",
}


def _business_rows() -> str:
    """Columns by a rule, so that each is null, empty and repeated somewhere, and no two in the same rows."""
    text = "case when c_custkey % {a} = 1 then null when c_custkey % 17 = {b} then '' else concat('{n}  ', cast(c_custkey % {c} as varchar(20))) end"
    columns = ["c_custkey id", "c_custkey number", "c_custkey job_id", f"cast({_DAY0} + (c_custkey % 700) * interval '1' hour as {{T}}) created_at"]
    columns += ["case when c_custkey % 7 > 0 then (c_custkey * 3) % 140 end question_id", "case when c_custkey % 9 > 0 then (c_custkey * 3) % 140 end response_id"]
    columns += ["c_custkey % 3 sort_order", "c_custkey % 3 = 0 confirmed", "case when c_custkey % 4 > 0 then split(substring('s1,s2,s3', 1, 2 + 3 * cast(c_custkey % 3 as int)), ',') end completed_step_ids"]
    columns += [f"case when c_custkey % {5 + i} > 0 then (c_custkey * {i + 2}) % 140 end {n}" for i, n in enumerate(_KEYS)]
    columns += [f"cast(case when c_custkey % {4 + i % 3} <> 2 then {_DAY0} + (c_custkey * {i + 3} % 900) * interval '1' hour end as {{T}}) {n}" for i, n in enumerate(_TIMES)]
    columns += [f"{_SPECIAL.get(n) or text.format(a=3 + i % 5, b=i % 17, c=7 + i, n=n)} as {n}" for i, n in enumerate(_TEXTS)]
    return f"select {', '.join(columns)} from {{customer}}"


ADAPTERS["business_rows"] = _business_rows()
BUSINESS_COLUMNS = frozenset([*_KEYS, *_TIMES, *_TEXTS])
ADAPTERS["feature_flags"] = "select concat('flag', cast(n_nationkey as varchar(20))) as key, n_nationkey % 2 = 0 enabled, n_nationkey % 5 = 0 kill_switch from {nation}"
ADAPTERS["portfolio_aliases"] = "select cast(r_regionkey + 3 as bigint) portfolio_id, concat('alias', cast(r_regionkey as varchar(20))) alias from {region}"


def adapter_sql(name: str, dialect: str) -> str:
    """An adapter's text for 'spark', base tables in braces, or for 'duckdb', where they are views."""
    spark = dialect == "spark"
    get = "get_json_object(props, '$.k')" if spark else "json_extract_string(props, '$.k')"
    text = ADAPTERS[name].replace("{J}", f"cast(cast({get} as int) % 10 as varchar(20))")
    text = text.replace("{T}", "timestamp_ntz" if spark else "timestamp")
    # Doubled braces are braces, as in a format string.
    return text if spark else re.sub(r"\{(\w+)\}", r"\1", text).replace("{{", "{").replace("}}", "}")


class Tables:
    """Base tables and adapters of one folder, as lazy DataFrames: ``Tables(spark, sf_dir).memories``.

    Each is made once per object, so files are listed and their schema is read once; a new object sees new files.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, loaded: dict[str, str] | None = None):
        self.spark, self.sf_dir, self.loaded = spark, sf_dir, loaded or {}

    def load(self, path: str, names: Iterable[str], files: int, derived: dict[str, Callable[[Tables], DataFrame]] | None = None) -> Tables:
        """Writes tables or adapters as Parquet of so many files each, and gives tables that read them from there.

        ``derived`` names tables that are made from the others and written as they are.
        """
        loaded = dict(self.loaded)
        for name in names:
            loaded[name] = f"{path}/{name}.parquet"
            getattr(self, name).repartition(files).write.mode("overwrite").parquet(loaded[name])
        for name, build in (derived or {}).items():
            loaded[name] = f"{path}/{name}.parquet"
            build(self).write.mode("overwrite").parquet(loaded[name])
        return Tables(self.spark, self.sf_dir, loaded)

    def memory_texts(self) -> DataFrame:
        """``memories`` without their vectors.

        A join with ids that don't recur leaves each row once, and as only its left side is read Spark drops it once it knows that they don't: no text is
        sent through a shuffle.  Where an id recurs the join is made.
        """
        if "memories" in self.loaded:
            return self.memories.drop("embedding")
        alone = self
        if self.embeddings.groupBy("vec_id").count().filter("count > 1").isEmpty():
            alone = Tables(self.spark, self.sf_dir, self.loaded)
            alone.__dict__ |= self.__dict__ | {"embeddings": self.embeddings.dropDuplicates(["vec_id"])}
            alone.__dict__.pop("memories", None)
        return alone.memories.drop("embedding")

    def __getattr__(self, name: str) -> DataFrame:
        if name in self.loaded:
            made = self.spark.read.parquet(self.loaded[name])
        elif name in BASE:
            made = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in ADAPTERS:
            text = adapter_sql(name, "spark")
            made = self.spark.sql(text, **{t: getattr(self, t) for t in sorted(set(re.findall(r"\{(\w+)\}", text)))})
        else:
            raise AttributeError(name)
        self.__dict__[name] = made
        return made


def with_adapters(sql: str) -> str:
    """DuckDB text with the adapters it names as common table expressions in front."""
    used = [n for n in ADAPTERS if re.search(rf"\b{n}\b", sql)]
    ctes = ",\n".join(f"{n} as ({adapter_sql(n, 'duckdb')})" for n in used)
    if not ctes:
        return sql
    body = sql.strip()
    if re.match(r"with\s+recursive\b", body, re.I):
        return f"with recursive {ctes},\n{re.sub(r'^with\s+recursive', '', body, flags=re.I)}"
    if re.match(r"with\b", body, re.I):
        return f"with {ctes},\n{body[4:]}"
    return f"with {ctes}\n{body}"
