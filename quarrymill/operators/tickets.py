"""Tickets: lookup, feature keywords, and the change plan made from evidence."""

from __future__ import annotations

import textwrap

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.operators import evidence
from quarrymill.session import materialized

#: Words that are no keywords, the least length of others, and how many are kept.
STOP_WORDS = ("add", "fix", "modify", "update", "change", "the", "a", "an", "to", "in", "for", "of", "and", "or", "after", "before")
LONGER_THAN, MOST_KEYWORDS = 4, 3
LISTED = ("key", "summary", "status", "priority", "ticket_type")


def feature_keywords(affected_feature: Column, summary: Column) -> Column:
    """The named feature, then distinct long words of the summary; three at most."""
    words = F.filter(
        F.split(F.lower(F.coalesce(summary, F.lit(""))), r"[\s\p{Z}]+"), lambda w: (F.length(w) > LONGER_THAN) & ~w.isin(*STOP_WORDS)
    )
    named = F.when(F.coalesce(affected_feature, F.lit("")) != "", F.array(affected_feature)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(named, words)), 1, MOST_KEYWORDS)


def ticket(tickets: DataFrame, key: str) -> DataFrame:
    """The ticket with a key in any case; ValueError where there is none."""
    found = tickets.filter(F.upper("key") == key.upper())
    if found.isEmpty():
        raise ValueError(f"unknown ticket {key}")
    return found


def ticket_list(tickets: DataFrame) -> DataFrame:
    return tickets.select(*LISTED)


def plan_items(tickets: DataFrame, endpoints: DataFrame, components: DataFrame) -> DataFrame:
    """(part, item) rows of a change plan: components, files, impact and checklist.

    ``endpoints`` and ``components`` are the evidence of one feature; the ticket is one row.
    """
    is_bug = F.lower(F.coalesce("ticket_type", F.lit(""))) == "bug"
    first = F.when(is_bug, "reproduce the defect and add a failing test").otherwise("agree on the change of behaviour and its tests")
    parts = [
        endpoints.select(F.lit("component").alias("part"), F.concat_ws(" ", "method", "path", "handler_class").alias("item")),
        endpoints.filter("backend_file <> ''").select(F.lit("file").alias("part"), F.col("backend_file").alias("item")),
        components.select(F.lit("impact").alias("part"), F.concat_ws(" ", "class_name", F.lit("in"), "repo").alias("item")),
        tickets.select(F.lit("checklist").alias("part"), first.alias("item")),
        tickets.select(F.lit("checklist").alias("part"), F.lit("change the listed files and run their tests").alias("item")),
        components.limit(1).select(F.lit("checklist").alias("part"), F.lit("tell the owners of the callers").alias("item")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def render_plan(summary: str, items: DataFrame) -> str:
    """The plan as text; its rows are those of one ticket."""
    titles = {"component": "Components", "file": "Files", "impact": "Impact", "checklist": "Checklist"}
    rows = [(r["part"], r["item"]) for r in items.orderBy("part", "item").collect()]
    blocks = [f"# {summary}"]
    for part, title in titles.items():
        own = [f"- {item}" for p, item in rows if p == part]
        if own:
            blocks.append("\n".join([f"## {title}", *own]))
    return "\n\n".join(blocks) + "\n"


#: What is to be done for a defect and for anything else.
STEPS = {
    True: ("reproduce the defect through a listed endpoint", "add a test that fails because of it", "mend the handler", "run the tests along the chain", "extend the integration tests"),
    False: ("agree on requests and responses of the endpoints", "change the services of the chain", "change or add the handler", "check the outside boundaries", "test the new behaviour by units and by endpoint"),
}
WITH_CALLERS = "change the callers to the new responses"


def _table(title: str, lines: list[str]) -> str:
    return "\n".join([f"## {title}", *(lines or ["- none found"])])


def plan_text(one: DataFrame, traces: DataFrame, chunks: DataFrame, feature: str) -> str:
    """The whole change plan of one ticket as Markdown, from the evidence of its feature alone.

    Head, description, components (endpoints) with their normal paths, parameters and request and response
    classes, the chain, callers with the way they match, files to change (each once), outside
    boundaries, a checklist by the ticket's type, and where each fact comes from.  The same rows
    give the same text; what is read belongs to one feature.
    """
    row = one.first().asDict()
    ends = materialized(evidence.backend_endpoints(traces))
    whole = evidence.summary(traces).first()
    contracts = {(r["method"], r["path"]): r for r in evidence.api_contracts(ends, evidence.supporting_chunks(chunks, evidence.class_names(ends))).collect()}
    found = ends.orderBy("method", "path").collect()
    callers = evidence.frontend_components(ends).orderBy("class_name", "repo", "http_method", "called_path", "file_path").collect()
    head = [f"# {row['key']}: {row['summary']}", ""]
    head += [f"- {name}: {row.get(name) or 'not given'}" for name in ("ticket_type", "status", "priority")]
    head.append(f"- feature: {feature or 'not given'}, confidence {whole['confidence']:.2f}")
    endpoints = []
    for r in found:
        dto = contracts.get((r["method"], r["path"]))
        endpoints.append(f"- {r['method']} {r['path']} (normally {r['normalized_path']}) in {r['repo']}: {r['handler_class'] or 'no handler'} [{r['handler_kind']}]")
        said = {"parameters": ", ".join(r["path_params"] or []), "request": dto and dto["request_dto"], "response": dto and dto["response_dto"]}
        endpoints += [f"  - {name}: {value}" for name, value in said.items() if value]
    files = dict.fromkeys(f"- [{r['repo']}] {r['backend_file']}" for r in found if r["backend_file"])
    outside = evidence.unresolved_hops(traces).orderBy("name").collect()
    is_bug = (row.get("ticket_type") or "").lower() == "bug"
    steps = [*STEPS[is_bug], *([WITH_CALLERS] if callers and not is_bug else [])]
    origin = evidence.provenance(traces).orderBy("step", "message").collect()
    blocks = [
        "\n".join(head), "\n".join(["## Description", textwrap.fill(row.get("description") or "", 100)]), _table("Components", endpoints),
        _table("Chain", ["- " + " > ".join(whole["service_chain"])] if whole["service_chain"] else []),
        _table("Callers", [f"- {r['class_name']} in {r['repo']} {r['file_path']} calls {r['http_method']} {r['called_path']} ({r['matched_via']}, {r['confidence']:.2f})" for r in callers]),
        _table("Files", list(files)), _table("Outside boundaries", [f"- {r['name']} ({r['hop_type']})" for r in outside]), _table("Checklist", [f"- [ ] {x}" for x in steps]),
        _table("Provenance", [f"{k}. {r['message']}" for k, r in enumerate(origin, 1)]),
    ]
    return "\n\n".join(blocks) + "\n"
