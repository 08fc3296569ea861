"""The tool layer: 25 named operations with dict arguments and an envelope, allowlists and plugins."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteloom.errors import EngineError, not_found
from noteloom.functions.dynamic import Filter
from noteloom.functions.parsing import body, frontmatter_block
from noteloom.functions.yamlio import mapping_json
from noteloom.operators import graph, memory, notes as note_views, properties, suggest, tasks, templates
from noteloom.operators.index import StoredIndex
from noteloom.operators.memory_store import MemoryStore
from noteloom.operators.search import mode_of
from noteloom.operators.store import NoteStore, check_id
from noteloom.plans import sandbox
from noteloom.sources import vault

VERSION = "0.1.0"
READ_TOOLS = {
    "recall": "Ranked memories within a token budget, with conflicts.",
    "search": "Ranked snippets of notes.",
    "get_note": "A note's outline, frontmatter or full text.",
    "graph_query": "Links, backlinks or neighbours of a note.",
    "suggest_links": "Notes that a note should link to.",
    "list_notes": "All notes.",
    "propose_changes": "A dry run of changes.",
    "audit_log": "The latest commits and reverts.",
    "properties_query": "Structured queries over frontmatter.",
    "list_templates": "Templates and their variables.",
    "list_tasks": "Checklist tasks.",
    "get_version": "What a version changed.",
    "capabilities": "The tools and the scope of this session.",
}
WRITE_TOOLS = {
    "remember": "Store a memory with its source.",
    "forget": "Remove a memory.",
    "commit_changes": "Apply a proposed change.",
    "revert": "Undo a version.",
    "create_note": "Create a note.",
    "update_note": "Change a note.",
    "delete_note": "Delete a note.",
    "link": "Link one note to another.",
    "tag": "Tag a note.",
    "create_from_template": "Create a note from a template.",
    "toggle_task": "Flip a task's box.",
    "rename_note": "Rename a note and its links.",
}
TOOLS = READ_TOOLS | WRITE_TOOLS
HOOKS = ("note_saved",)
#: Tool calls of one plugin run, and characters of its answer, at most.
PLUGIN_CALLS, PLUGIN_BYTES = 1000, 64 << 20


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    """Rows of a bounded answer as dicts, absent fields left out."""

    def plain(v: Any) -> Any:
        if hasattr(v, "asDict"):
            return {k: plain(x) for k, x in v.asDict().items()}
        return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v

    return [plain(r) for r in df.collect()]


def _need(args: dict[str, Any], *names: str) -> list[Any]:
    for n in names:
        if args.get(n) is None:
            raise EngineError("INVALID_INPUT", f"The argument {n!r} is missing.", "See capabilities for the tools.")
    return [args[n] for n in names]


def _whole(args: dict[str, Any], name: str) -> int | None:
    v = args.get(name)
    if v is None:
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)) or v != int(v) or v < 0:
        raise EngineError("INVALID_INPUT", f"{name!r} must be a whole number, not {v!r}.", "Pass 0 or more.")
    return int(v)


class Engine:
    """Notes, memories and templates under one shared folder.

    Parsed notes are kept between calls and made anew after a change. The search index is stored; a change adds the postings
    of its own notes to it.
    """

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, origin: str | None = None):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.store = NoteStore(spark, f"{self.root}/store", read_only, origin)
        self.memory = MemoryStore(spark, f"{self.root}/memory")
        self.stored = StoredIndex(spark, f"{self.root}/index")
        self._kept: tuple[int, DataFrame] | None = None

    def import_vault(self, path: str, own_dir: str = vault.OWN_DIR) -> None:
        """Take in a Markdown vault with its memories and templates."""
        self.store.load(vault.scan(self.spark, path, own_dir).select(F.regexp_replace("path", r"\.md$", "").alias("note_id"), "raw"))
        self.memory.save(vault.memories(self.spark, path, own_dir))
        for r in vault.templates(self.spark, path, own_dir).toLocalIterator():
            self.save_template(r.name, r.raw)

    def save_template(self, name: str, raw: str) -> None:
        self.store.files.write(f"templates/{templates.check_name(name)}.md", raw)

    def _template_table(self) -> DataFrame:
        return vault.scan(self.spark, f"{self.store.root}/templates", own_dir="").select(F.regexp_replace("path", r"\.md$", "").alias("name"), "raw")

    def notes(self) -> DataFrame:
        return self._current()[1]

    def index(self) -> StoredIndex:
        """The stored index, brought to the store's state: by the changed notes alone where the store's layers tell them."""
        n, notes = self._current()
        have = self.stored.state()
        if have != n:
            notes = notes.select("id", "title", "content")
            changed = None if have is None else self.store.table.changed_since(have)
            if changed is None:
                self.stored.build(notes, n)
            else:
                ids = changed.select(F.col("note_id").alias("id"))
                now = notes.join(ids, "id", "left_semi")
                self.stored.update(now, ids.join(now.select("id"), "id", "left_anti"), n)
                self.stored.merge()
        return self.stored

    def _current(self) -> tuple[int, DataFrame]:
        n = self.store.generation()
        if self._kept is None or self._kept[0] != n:
            if self._kept is not None:
                self._kept[1].unpersist()
            self._kept = (n, self.store.notes().persist())
        return self._kept

    # dispatch
    def dispatch(self, tool: str, args: dict[str, Any] | None = None, allowlist: set[str] | None = None) -> dict[str, Any]:
        """{'ok': True, 'data': ...} or {'ok': False, 'error': {code, reason, suggestion}}; never raises."""
        try:
            if tool not in TOOLS:
                raise EngineError("INVALID_INPUT", f"There is no tool {tool!r}.", "capabilities lists the tools.")
            if allowlist is not None and tool not in allowlist:
                raise EngineError("PERMISSION_DENIED", f"The tool {tool!r} isn't allowed here.", "Ask for it in the manifest.")
            if args is not None and not isinstance(args, dict):
                raise EngineError("INVALID_INPUT", "Arguments must be an object.", "Pass named arguments.")
            if self.read_only and tool in WRITE_TOOLS:
                raise EngineError("PERMISSION_DENIED", "This session may only read.", "Open the store for writing.")
            return {"ok": True, "data": getattr(self, f"_{tool}")(args or {})}
        except EngineError as e:
            return {"ok": False, "error": e.as_dict()}
        except Exception as e:  # an envelope for whatever goes wrong below
            return {"ok": False, "error": EngineError("INTERNAL", f"{type(e).__name__}: {e}"[:500], "Report this.").as_dict()}

    def _known(self, note_id: Any) -> str:
        if self.notes().where(F.col("id") == check_id(note_id)).isEmpty():
            raise not_found(note_id)
        return note_id

    # reading tools
    def _recall(self, a: dict) -> dict:
        (query,) = _need(a, "query")
        items, conflicts = memory.recall(self.memory.table(), str(query), a.get("type"), _whole(a, "token_budget"))
        out = []
        for r in _rows(items):
            score, tokens = r.pop("score"), r.pop("token_count")
            out.append({"memory": {k: v for k, v in r.items() if v is not None}, "score": score, "token_count": tokens})
        return {"items": out, "conflicts": _rows(conflicts)}

    def _search(self, a: dict) -> dict:
        (query,) = _need(a, "query")
        hits = self.index().search(str(query), mode_of(a.get("mode")), _whole(a, "token_budget"), _whole(a, "top_k"))
        return {"hits": _rows(hits)}

    def _get_note(self, a: dict) -> dict:
        (note_id,) = _need(a, "note_id")
        one = note_views.get_notes(self.notes().where(F.col("id") == self._known(note_id)), a.get("format"), _whole(a, "max_tokens"))
        return _rows(one)[0]

    def _graph_query(self, a: dict) -> dict:
        start, relation = _need(a, "from", "relation")
        found = graph.graph_query(self.notes(), self._known(start), relation, _whole(a, "depth") or 1)
        return {"from": start, "relation": relation, "nodes": _rows(found)}

    def _suggest_links(self, a: dict) -> dict:
        (note_id,) = _need(a, "note_id")
        found = suggest.suggest_links(self.notes(), self._known(note_id), _whole(a, "top_k"), a.get("min_score"), _whole(a, "token_budget"), self.index())
        return {"note_id": note_id, "suggestions": _rows(found)}

    def _list_notes(self, a: dict) -> dict:
        return {"notes": _rows(note_views.list_notes(self.notes()))}

    def _propose_changes(self, a: dict) -> dict:
        (ops,) = _need(a, "ops")
        if not isinstance(ops, list) or not all(isinstance(o, dict) for o in ops):
            raise EngineError("INVALID_INPUT", "ops must be a list of objects.", "Pass {op, note_id, ...} objects.")
        if any(o.get("op") not in ("create", "update", "delete") for o in ops):
            raise EngineError("INVALID_INPUT", "Unknown op.", "Use create, update or delete.")
        return self.store.propose(ops)

    def _audit_log(self, a: dict) -> dict:
        limit = _whole(a, "limit")
        return {"entries": [{k: v for k, v in r.items() if v is not None} for r in _rows(self.store.audit_log(50 if limit is None else limit))]}

    def _properties_query(self, a: dict) -> dict:
        filters = [Filter(str(f.get("key")), f.get("op"), f.get("value")) for f in a.get("filters") or []]
        found = properties.properties_query(self.notes(), filters, a.get("select"), a.get("sort_by"), bool(a.get("descending")), _whole(a, "limit"), _whole(a, "token_budget"))
        return {"rows": [r | {"properties": json.loads(r["properties"])} for r in _rows(found)]}

    def _list_templates(self, a: dict) -> dict:
        return {"templates": _rows(templates.templates(self._template_table()).select("name", "vars"))}

    def _list_tasks(self, a: dict) -> dict:
        found = tasks.list_tasks(self.notes(), a.get("done"), a.get("due_before"), a.get("due_after"), a.get("tag"), a.get("note_id"), _whole(a, "limit"), _whole(a, "token_budget"))
        return {"tasks": [{k: v for k, v in r.items() if v is not None} for r in _rows(found)]}

    def _get_version(self, a: dict) -> dict:
        (version_id,) = _need(a, "version_id")
        tokens = _whole(a, "max_tokens")
        change_id = self.store.version(version_id).change_id
        found = self.store.get_version(version_id, bool(a.get("include_content")), 500 if tokens is None else tokens)
        return {"version_id": version_id, "change_id": change_id, "notes": _rows(found)}

    def _capabilities(self, a: dict) -> dict:
        listed = [{"name": n, "description": TOOLS[n]} for n in sorted(TOOLS)]
        return {"server": "noteloom", "version": VERSION, "tools": listed, "permissions": {"scope": "read-only" if self.read_only else "read-write"}}

    # writing tools
    def _remember(self, a: dict) -> dict:
        return {"memory_id": self.memory.remember(a)}

    def _forget(self, a: dict) -> dict:
        (memory_id,) = _need(a, "memory_id")
        return {"removed": self.memory.forget(str(memory_id))}

    def _commit_changes(self, a: dict) -> dict:
        return self.store.commit(_need(a, "change_id")[0])

    def _revert(self, a: dict) -> dict:
        return self.store.revert(_need(a, "version_id")[0])

    def _create_note(self, a: dict) -> dict:
        note_id, content = _need(a, "note_id", "content")
        return self.store.create(note_id, content, a.get("frontmatter"))

    def _update_note(self, a: dict) -> dict:
        return self.store.update(_need(a, "note_id")[0], a.get("content"), a.get("frontmatter"))

    def _delete_note(self, a: dict) -> dict:
        return self.store.delete(_need(a, "note_id")[0])

    def _link(self, a: dict) -> dict:
        return self.store.link(*_need(a, "from", "to"))

    def _tag(self, a: dict) -> dict:
        return self.store.tag(*_need(a, "note_id", "tag"))

    def _create_from_template(self, a: dict) -> dict:
        name, note_id = _need(a, "template", "note_id")
        raw = self.store.files.read(f"templates/{templates.check_name(str(name))}.md")
        if raw is None:
            raise EngineError("TEMPLATE_NOT_FOUND", f"There is no template {name!r}.", "list_templates gives the names.")
        text = templates.render(raw, a.get("vars") or {})
        row = self.spark.range(1).select(F.lit(text).alias("raw")).select(frontmatter_block("raw").alias("f"), body("raw").alias("b")).first()
        return self.store.create(note_id, row.b, json.loads(mapping_json(row.f)) or None) | {"note_id": note_id}

    def _toggle_task(self, a: dict) -> dict:
        note_id, line, text = _need(a, "note_id", "line", "expect_text")
        return self.store.toggle_task(note_id, int(line), str(text))

    def _rename_note(self, a: dict) -> dict:
        return self.store.rename(*_need(a, "from", "to"))


def check_manifest(manifest: dict[str, Any], read_only: bool) -> dict[str, Any]:
    """A plugin's manifest (name, entry, tools, hooks), or the error that refuses it."""

    def refuse(why: str) -> EngineError:
        return EngineError("INVALID_MANIFEST", why, "Correct the manifest.")

    if not manifest.get("name"):
        raise refuse("A plugin needs a name.")
    entry = str(manifest.get("entry") or "")
    if not entry or entry.startswith("/") or ".." in entry.split("/"):
        raise refuse("The entry must lie inside the plugin's folder.")
    for tool in manifest.get("tools") or []:
        if tool not in TOOLS:
            raise refuse(f"There is no tool {tool!r}.")
        if read_only and tool in WRITE_TOOLS:
            raise refuse(f"The tool {tool!r} writes, and this session may only read.")
    for hook in manifest.get("hooks") or []:
        if hook not in HOOKS:
            raise refuse(f"There is no hook {hook!r}.")
    return manifest


class Plugins:
    """Python callables that reach the engine through an allowlist of tools.

    A plugin runs in a process of its own, within bounds of time and memory (``sandbox``); one registered as ``trusted`` runs in this one.
    """

    def __init__(self, engine: Engine, cpu_s: int = sandbox.CPU_S, memory: int = sandbox.MEMORY, wait_s: float = sandbox.WAIT_S):
        self.engine, self.limits = engine, {"cpu_s": cpu_s, "memory": memory, "wait_s": wait_s}
        self._found: dict[str, tuple[dict[str, Any], Callable, bool]] = {}
        engine.store.after_commit.append(self._saved)

    def register(self, manifest: dict[str, Any], function: Callable[[Callable, dict[str, Any]], Any], trusted: bool = False) -> None:
        """The function gets (call, input); call(tool, args) returns an envelope and is held to the manifest's tools."""
        self._found[manifest["name"]] = (check_manifest(manifest, self.engine.read_only), function, trusted)

    def run(self, name: str, given: dict[str, Any]) -> dict[str, Any]:
        """The plugin's answer in an envelope; what it raises or exceeds is a trap, what isn't JSON breaks the contract."""
        if name not in self._found:
            return {"ok": False, "error": EngineError("INVALID_INPUT", f"There is no plugin {name!r}.").as_dict()}
        manifest, function, trusted = self._found[name]
        allowed = set(manifest.get("tools") or [])
        calls = 0

        def call(tool: str, args: dict[str, Any] | None = None) -> dict[str, Any]:
            nonlocal calls
            calls += 1
            if calls > PLUGIN_CALLS:
                raise RuntimeError(f"more than {PLUGIN_CALLS} calls")
            return self.engine.dispatch(tool, args, allowed)

        try:
            answer = function(call, given) if trusted else sandbox.run(function, given, call, PLUGIN_BYTES, **self.limits)
        except sandbox.BadAnswer as e:
            return {"ok": False, "error": EngineError("PLUGIN_ABI", str(e)).as_dict()}
        except sandbox.Trap as e:
            return {"ok": False, "error": EngineError("PLUGIN_TRAP", str(e)).as_dict()}
        except Exception as e:
            return {"ok": False, "error": EngineError("PLUGIN_TRAP", f"{type(e).__name__}: {e}").as_dict()}
        try:
            made = json.dumps(answer)
            if len(made) > PLUGIN_BYTES:
                raise ValueError(f"the answer is larger than {PLUGIN_BYTES} characters")
            return {"ok": True, "data": json.loads(made)}
        except (TypeError, ValueError) as e:
            return {"ok": False, "error": EngineError("PLUGIN_ABI", str(e)).as_dict()}

    def _saved(self, notes: list[str]) -> None:
        for name, (manifest, _, _) in self._found.items():
            if "note_saved" in (manifest.get("hooks") or []):
                self.run(name, {"hook": "note_saved", "notes": notes})
