"""The declared ontology, the families of edges that foreign keys give, and reconciling it with what is there."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import paired
from .rollups import fk_edges

# Entity types.
ENTITY_TYPES = (
    "venture", "person", "portfolio", "agent", "repo", "learning", "goal", "roadmap", "okr", "campaign", "channel", "meeting", "issue",
    "activity", "feed", "doc", "code_module",
)
# Relations with the types of their ends; None where they vary.
RELATIONS = {
    "BELONGS_TO": ("venture", "portfolio"), "MEMBER_OF": ("person", "venture"), "OWNS": ("person", "venture"), "ASSIGNED_TO": ("person", "venture"),
    "AUTHORED_IN": ("person", "venture"), "DEPENDS_ON": ("venture", "venture"), "LEADS_BD_FOR": ("person", "venture"), "EXPERT_FOR": ("agent", "venture"),
    "WORKS_ON": ("agent", "venture"), "COMMITS_TO": ("person", "repo"), "REPO_OF": ("repo", "venture"), "APPLIES_TO": ("learning", "venture"),
    "RECORDED": ("person", "learning"), "PURSUES": ("person", "goal"), "GOAL_FOR": ("goal", "venture"), "PLANS": ("roadmap", "venture"),
    "TARGETS": ("okr", "venture"), "PROMOTES": ("campaign", "venture"), "RUNS_CAMPAIGN": ("person", "campaign"), "CHANNEL_OF": ("channel", "venture"),
    "ATTENDED": ("person", "meeting"), "MEETING_ABOUT": ("meeting", "venture"), "ATTENDED_WITH": ("person", "person"), "ISSUE_IN": ("issue", "venture"),
    "DISCUSSED_IN": (None, None), "AGENT_DISCUSSED_IN": ("agent", "issue"), "ACTED_ON": ("agent", "venture"), "AUTHORED_PR_IN": ("person", "repo"),
    "ACTIVITY_OF": ("activity", "person"), "ACTIVITY_IN": ("activity", "repo"), "FEED_OF": ("feed", "venture"), "FEED_IN": ("feed", "portfolio"),
    "POSTED_IN": ("person", "feed"), "ORGANIZED": ("person", "meeting"), "DOC_IN": ("doc", "repo"), "CODE_IN": ("code_module", "repo"),
    "REPO_IN": ("repo", "portfolio"), "USED_AI_ON": ("person", "repo"),
}
#: For each family of edges the tables that it is read from: table, columns of its ends, and the domain type under which a row
#: of it is a memory that can be cited as the edge's source, or None.
FAMILIES = {
    "BELONGS_TO": (("ventures", "id", "portfolio_id", "venture"),), "MEMBER_OF": (("venture_members", "user_id", "venture_id", None),),
    "WORKS_ON": (("venture_members", "agent_id", "venture_id", None),), "OWNS": (("venture_responsibilities", "owner_id", "venture_id", "responsibility"),),
    "ASSIGNED_TO": (("issues", "assignee_id", "venture_id", "issue"),), "AUTHORED_IN": (("posts", "author_id", "venture_id", "post"),),
    "DEPENDS_ON": (("venture_dependencies", "venture_id", "depends_on_id", "dependency"),), "LEADS_BD_FOR": (("bd_deals", "owner_id", "venture_id", "pipeline"),),
    "EXPERT_FOR": (("harvester_items", "agent_id", "venture_id", "harvested"),), "APPLIES_TO": (("issue_learnings", "learning_id", "venture_id", "learning"),),
    "RECORDED": (("issue_learnings", "author_id", "learning_id", "learning"),), "PURSUES": (("user_goals", "user_id", "goal_id", "goal"),),
    "GOAL_FOR": (("venture_goals", "goal_id", "venture_id", "goal"),), "PLANS": (("roadmaps", "roadmap_id", "venture_id", "roadmap"),),
    "TARGETS": (("venture_okr_snapshots", "okr_id", "venture_id", "okr"), ("venture_okr_targets", "okr_id", "venture_id", "okr")),
    "PROMOTES": (("marketing_campaigns", "campaign_id", "venture_id", "marketing"),), "RUNS_CAMPAIGN": (("marketing_campaigns", "owner_id", "campaign_id", "marketing"),),
    "CHANNEL_OF": (("channels", "channel_id", "venture_id", "channel"),), "ATTENDED": (("calendar_event_attendees", "user_id", "meeting_id", "calendar-event"),),
    "MEETING_ABOUT": (("calendar_events", "meeting_id", "venture_id", "calendar-event"),), "ISSUE_IN": (("issues", "issue_id", "venture_id", "issue"),),
    "DISCUSSED_IN": (("issue_comments", "author_id", "issue_id", "issue-thread"),), "AGENT_DISCUSSED_IN": (("issue_comments", "agent_id", "issue_id", "issue-thread"),),
    "ACTED_ON": (("agent_actions", "agent_id", "venture_id", None),), "AUTHORED_PR_IN": (("pull_authors", "user_id", "repo_full_name", None),),
    "COMMITS_TO": (("github_commits", "author_login", "repo_full_name", None),),
}


def family_edges(table: Callable[[str], DataFrame], relations: Sequence[str] = ()) -> DataFrame:
    """Edges of the families, by default of all: src, dst, relation, ref, one row a record; an end that is null is no edge.

    ``table`` gives a source table by its name; each is one projection, so nothing is shuffled.
    """
    out = None
    for relation in relations or FAMILIES:
        for name, src, dst, kind in FAMILIES[relation]:
            rows = table(name)
            ref = F.concat(F.lit(f"db:{kind}:"), F.col("id").cast("string")) if kind else F.lit(None).cast("string")
            edges = fk_edges(rows, relation, F.col(src).cast("string"), F.col(dst).cast("string"), ref)
            out = edges if out is None else out.unionByName(edges)
    return out


def together(rows: DataFrame, group: str, member: str, relation: str = "ATTENDED_WITH") -> DataFrame:
    """Pairs that share a group (two people in one meeting), each once, with how often; large groups are paired in blocks."""
    pairs = paired(rows, group, member).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("times")).withColumn("relation", F.lit(relation))


def reconciled(declared: DataFrame, entities: DataFrame) -> DataFrame:
    """All types, declared or seen, with their nodes, and where they come from."""
    seen = entities.filter("entity_type is not null").groupBy(F.col("entity_type").alias("name")).agg(F.count(F.lit(1)).alias("nodes"))
    both = declared.select("name", F.lit(True).alias("declared")).join(seen, "name", "full_outer")
    origin = F.when(F.col("declared").isNotNull(), "declared").otherwise("observed")
    return both.select("name", origin.alias("origin"), F.coalesce("nodes", F.lit(0)).cast("long").alias("nodes"))


def to_register(declared_types: DataFrame, declared_relations: DataFrame, entities: DataFrame, edges: DataFrame) -> DataFrame:
    """What reconciling adds to an ontology: kind, name, detail.

    Types of entities and relations of live edges that aren't declared, with their numbers, and relations whose declared
    (name, src_type, dst_type) differ from what their live edges show.
    """
    from .graph import endpoint_types

    def missing(seen: DataFrame, declared: DataFrame, kind: str) -> DataFrame:
        by = seen.filter("name is not null").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
        return by.join(declared.select("name"), "name", "left_anti").select(F.lit(kind).alias("kind"), "name", F.col("n").cast("string").alias("detail"))

    live = edges.filter("valid_to is null")
    shown = endpoint_types(edges, entities).withColumnRenamed("relation", "name").join(declared_relations.select("name", "src_type", "dst_type"), "name", "left")
    same = F.col("src_type").eqNullSafe(F.col("src_types")) & F.col("dst_type").eqNullSafe(F.col("dst_types"))
    ends = shown.filter(~same).select(F.lit("endpoint types").alias("kind"), "name", F.concat("src_types", F.lit(" -> "), "dst_types").alias("detail"))
    return (
        missing(entities.select(F.col("entity_type").alias("name")), declared_types, "entity_type")
        .unionByName(missing(live.select(F.col("relation").alias("name")), declared_relations, "edge_type")).unionByName(ends)
    )
