"""Deterministic routing: which operator answers which kind of question, as plain data.

Plans are lists of steps; a step names an operator of REGISTRY and its parameters. run() executes
them lazily: DataFrames are only built, and a fallback is tried where a step's result is empty.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of


@dataclass(frozen=True)
class Step:
    store: str
    method: str
    params: dict[str, Any] = field(default_factory=dict)
    result: str = "results"
    required: bool = True
    fallback: str | None = None


# The operators that questions reach, by name, in the order in which they are offered.
REGISTRY: dict[str, str] = {
    "get_papers_id_by_author": "graph_db", "get_papers_id_by_title": "graph_db", "get_papers_citing_paper": "graph_db",
    "get_papers_cited_by_paper": "graph_db", "get_paragraphs_citing_paper": "graph_db", "get_sentences_citing_paper": "graph_db",
    "get_metadata_by_paper_id": "graph_db", "search_relevant_sentences": "vector_db", "search_relevant_paragraphs": "vector_db",
    "search_relevant_sections": "vector_db", "search_all_content_types": "vector_db", "query_pdf_content": "pdf",
    "query_pdf_by_author_and_content": "pdf", "query_pdf_by_title_and_content": "pdf", "semantic_search_pdf_content": "pdf",
    "get_full_pdf_content": "pdf", "search_all_collections": "vector_db",
}
# What results are called.
RESULT_NAMES = {"get_papers_citing_paper": "citing_papers", "get_papers_cited_by_paper": "cited_papers", "get_sentences_citing_paper": "citing_sentences", "get_papers_id_by_author": "author_papers", "get_full_pdf_content": "full_text"}
ENTITY_TYPES = ("author", "paper", "concept", "institution", "unknown")
# Focus of a question: the operator to ask, those to ask besides, and what to do without results.
STRATEGIES: dict[str, tuple[str, tuple[str, ...], str | None]] = {
    "reverse_citation_with_content": ("get_papers_citing_paper", ("get_sentences_citing_paper",), "vector_search_by_author"),
    "reverse_citation": ("get_papers_citing_paper", (), None),
    "forward_citation": ("get_papers_cited_by_paper", (), None),
    "author_analysis": ("get_papers_id_by_author", (), "vector_search_by_author"),
}
# Words of a question that ask for a route.
ROUTE_WORDS = {
    "graph_analysis": ("cite", "citation", "referenced", "reference", "mention"),
    "vector_search": ("what is", "definition", "concept", "theory"),
    "content": ("what does it discuss", "content", "discussion", "paper"),
}
CONTENT_WORDS = ("content", "discuss", "say about", "mention", "describe", "full text", "explain")
NEEDS_ID = {"get_papers_citing_paper", "get_papers_cited_by_paper", "get_sentences_citing_paper"}


def routes(question: str, author: str | None = None) -> list[str]:
    """Routes that a question's words ask for, at least one."""
    q, out = question.lower(), []
    asks = lambda k: any(w in q for w in ROUTE_WORDS[k])
    everything = bool(author) and "all" in q
    if asks("graph_analysis"):
        out.append("graph_analysis")
    if asks("vector_search"):
        out.append("vector_search")
    if asks("content"):
        out.append("author_collection" if everything else "pdf_analysis")
    if everything and "author_collection" not in out:
        out.append("author_collection")
    elif author and not out:
        out.append("graph_analysis")
    return out or ["vector_search"]


def needs_disambiguation(asked: Sequence[str], author: str | None, year: int | None, title: str | None) -> bool:
    return bool(author) and not year and not title and not {"pdf_analysis", "graph_analysis"}.isdisjoint(asked)


def next_route(asked: Sequence[str], done: Sequence[str]) -> str:
    return next((r for r in asked if r not in done), "generate_response")


def after_analysis(clarify: bool, author: str | None, citation_question: bool) -> str:
    if clarify:
        return "clarification"
    return "disambiguate" if author else "direct_citation" if citation_question else "vector_search"


def after_disambiguation(clarify: bool, selected: int) -> str:
    return "clarification" if clarify else "citation_analysis" if selected else "vector_search"


def entity_type(name: str | None) -> str:
    n = (name or "").strip().lower()
    return n if n in ENTITY_TYPES else "unknown"


def is_content_question(question: str) -> bool:
    return any(w in question.lower() for w in CONTENT_WORDS)


def strategy(focus: str, has_id: bool) -> tuple[Step, list[Step], str | None]:
    """The first step, further ones, and the fallback. What needs an id and has none is searched for."""
    method, more, fallback = STRATEGIES.get(focus, ("search_all_collections", (), None))
    if method in NEEDS_ID and focus.startswith("reverse") and not has_id:
        method, more, fallback = "search_all_collections", (), None
    step = lambda m: Step(REGISTRY[m], m, result=RESULT_NAMES.get(m, "search_results"))
    return step(method), [step(m) for m in more], fallback


def params_for(method: str, target: dict[str, Any], question: str) -> dict[str, Any]:
    if method in NEEDS_ID or method == "get_full_pdf_content":
        return {"paper_id": target.get("paper_id")}
    if method == "get_papers_id_by_author":
        return {"author_name": target.get("name") or question}
    return {"query": target.get("title") or target.get("name") or question, "limit_per_collection": 10}


def searched(query: str, most: int = 10, required: bool = True, result: str = "search_results") -> Step:
    return Step("vector_db", "search_all_collections", {"query": query, "limit_per_collection": most}, result, required)


def last_resort(question: str) -> Step:
    """What is asked when no step gave anything, or there was none."""
    return searched(question, 5, False)


def plan(query_type: str, kind: str, target: dict[str, Any], question: str = "") -> list[Step]:
    """Steps for a classified question. target: paper_id, title, name, as far as known. Citations of a paper without an id are searched for
    by its name, those that it makes have no step (last_resort() is all there is), a known paper is searched by its id and
    the question. A question for content of a known paper also gets its text."""
    kind, paper = entity_type(kind), target.get("paper_id")
    name = target.get("name") or target.get("title") or question
    if query_type == "reverse_citation_analysis" and paper:
        found = [("get_papers_citing_paper", "citing_papers", "vector_search_by_author"), ("get_sentences_citing_paper", "citation_sentences", None)]
        steps = [Step("graph_db", m, {"paper_id": paper}, r, not i, f) for i, (m, r, f) in enumerate(found)]
    elif query_type == "reverse_citation_analysis":
        steps = [searched(f"citations to {name}")]
    elif query_type == "citation_analysis":
        steps = [Step("graph_db", "get_papers_cited_by_paper", {"paper_id": paper}, "cited_papers")] if paper else []
    elif query_type == "paper_search" and paper:
        steps = [searched(f"paper_id:{paper} {question}")]
    elif query_type in ("author_search", "paper_search") and kind == "author":
        steps = [Step("graph_db", "get_papers_id_by_author", {"author_name": name}, "author_papers", True, "vector_search_by_author")]
    elif query_type == "paper_search" and kind == "paper":
        steps = [searched(target.get("title") or name)]
    elif query_type == "concept_search" and kind == "concept":
        steps = [searched(name)]
    else:
        steps = [searched(question)]
    if paper and is_content_question(question):
        steps.append(Step("pdf", "get_full_pdf_content", {"paper_id": paper}, "full_text", False))
    return steps


def run(steps: Sequence[Step], operators: dict[str, Callable[..., DataFrame]], fallbacks: dict[str, Callable[..., DataFrame]] | None = None) -> dict[str, DataFrame]:
    """Results by name. operators: by method. A required step that is empty is replaced by the fallback of
    its strategy, if fallbacks has that, else by its store's."""
    out: dict[str, DataFrame] = {}
    for s in steps:
        if s.method not in operators:
            continue
        got = operators[s.method](**s.params)
        other = (fallbacks or {}).get(s.fallback or "", (fallbacks or {}).get(s.store))
        if s.required and other is not None and got.isEmpty():
            got = other(**s.params)
        out[s.result] = got
    return out


# What a reply contains, the first class that fits.
REPLIES = (
    ("continue", ("continue", "yes", "ok", "proceed", "1")),
    ("expand", ("expand", "more", "additional", "search", "2")),
    ("refine", ("refine", "modify", "change", "3")),
)


def reply_class(reply: str) -> str:
    low = reply.strip().lower()
    return next((k for k, hints in REPLIES if any(h in low for h in hints)), "continue")


def reply_column(reply: Column) -> Column:
    """reply_class as a column."""
    low = F.lower(F.trim(reply))
    out = F
    for k, hints in REPLIES:
        out = out.when(any_of(*(low.contains(h) for h in hints)), k)
    return out.otherwise("continue")


def sufficient(steps_done: int, rows: int, least: int = 1) -> bool:
    return steps_done > 0 and rows >= least


def retrieve(steps: Sequence[Step], operators: dict[str, Callable[..., DataFrame]], least: int = 1, enough: Callable[[int, int, int], bool] = sufficient) -> dict[str, DataFrame]:
    """Steps in the order of their priority until there is enough: no step runs beyond that, and a step
    counts its rows up to least only."""
    out: dict[str, DataFrame] = {}
    rows = done = 0
    for s in steps:
        if enough(done, rows, least):
            break
        if s.method in operators:
            out[s.result] = operators[s.method](**s.params)
            rows += out[s.result].limit(least).count()
            done += 1
    return out
