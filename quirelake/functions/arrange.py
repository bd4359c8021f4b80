"""Selection, order and rotation of a file's pages, and the cleaning of what pointed to pages that go."""

from __future__ import annotations

from typing import Any

from ..options import EditOptions
from . import content
from .pdf import Document, Encrypted, Name, PdfError, Ref, Stream, read, references, write_packed

TREE_LEVELS, OUTLINE_ITEMS = 64, 1_000_000


def arrange(data: bytes, plan: list[tuple[int, int]], options: EditOptions) -> dict:
    out: dict[str, Any] = {"content": data, "error": None, "pages_in": None, "pages_out": None, "outline_items_removed": 0, "links_removed": 0, "named_dests_removed": 0, "fields_removed": 0, "references_cleared": 0, "page_labels_dropped": False, "structure_dropped": False, "was_signed": False}
    try:
        if len(data) > options.max_input_bytes:
            raise PdfError("limit: input_bytes")
        return out | Arranger(read(data)).run(plan)
    except Encrypted:
        return out | {"error": "encrypted"}
    except (PdfError, ValueError, TypeError, KeyError, IndexError, RecursionError) as e:
        return out | {"error": str(e)[:200]}


class Arranger:
    def __init__(self, doc: Document):
        self.doc, self.leaves = doc, content.pages(doc)

    def run(self, plan: list[tuple[int, int]]) -> dict:
        sources = [s for s, _ in plan]
        if not plan:
            raise PdfError("the plan is empty")
        if any(not 0 <= s < len(self.leaves) for s in sources):
            raise PdfError("a page is out of range")
        if len({*sources}) < len(sources):
            raise PdfError("a page is named twice")
        from ..sources.tables import _Facts

        marks = _Facts(self.doc).signature()
        signed = marks["sig_nonzero"] or marks["sig_field"]
        identity = plan == [(i, 0) for i in range(len(self.leaves))]
        dropped = {p.ref for i, p in enumerate(self.leaves) if i not in {*sources}}
        self.rebuild(plan)
        out = {"pages_in": len(self.leaves), "pages_out": len(plan), "was_signed": bool(signed)}
        catalog = self.doc.catalog
        if dropped:
            names = self.named(dropped)
            out["named_dests_removed"] = len(names)
            self.targets = (dropped, names)
            out["outline_items_removed"] = self.outlines()
            out["links_removed"] = sum(self.links(self.leaves[s]) for s in sources)
            out["fields_removed"] = self.form(dropped)
            out["structure_dropped"] = catalog.pop("StructTreeRoot", None) is not None
            catalog.pop("MarkInfo", None)
        if not identity:
            out["page_labels_dropped"] = catalog.pop("PageLabels", None) is not None
        out["references_cleared"] = self.sweep(dropped)
        self.prune()
        return out | {"content": write_packed(self.doc)}

    def rebuild(self, plan: list[tuple[int, int]]) -> None:
        """One flat list of pages under the root; inherited attributes move down to each."""
        root = self.doc.catalog["Pages"]
        for source, turn in plan:
            page = self.leaves[source]
            raw = self.doc.get(page.inherited.get("Rotate", 0))
            raw = raw if isinstance(raw, (int, float)) and not isinstance(raw, bool) else 0
            own = {k: v for k, v in page.inherited.items()} | {"Rotate": (round(raw / 90) * 90 + turn) % 360, "Parent": root}
            page.dict.update(own)
        tree = self.doc.dict_of(root)
        kept = {k: v for k, v in tree.items() if k in ("Type",)}
        tree.clear()
        tree.update(kept | {"Type": Name("Pages"), "Kids": [self.leaves[s].ref for s, _ in plan], "Count": len(plan)})

    def hits(self, dest: Any) -> bool:
        """Whether a destination leads to a page that goes."""
        pages, names = self.targets
        dest = self.doc.get(dest)
        if isinstance(dest, dict):
            dest = self.doc.get(dest.get("D"))
        if isinstance(dest, list):
            return bool(dest) and isinstance(dest[0], Ref) and dest[0] in pages
        if isinstance(dest, Name):
            return dest.encode("latin-1") in names
        return isinstance(dest, bytes) and bytes(dest) in names

    def leads(self, own: dict) -> bool:
        action = self.doc.dict_of(own.get("A"))
        return self.hits(own.get("Dest")) or action.get("S") == "GoTo" and self.hits(action.get("D"))

    def named(self, dropped: set[Ref]) -> set[bytes]:
        """Names whose destination goes; they are taken out of the tree and of the old dictionary."""
        self.targets = (dropped, set())
        gone: set[bytes] = set()

        def tree(node: Any, depth: int) -> None:
            own = self.doc.dict_of(node)
            names = self.doc.get(own.get("Names"))
            if isinstance(names, list):
                kept = []
                for key, dest in zip(names[::2], names[1::2], strict=False):
                    if self.hits(dest):
                        gone.add(bytes(self.doc.get(key)))
                    else:
                        kept += [key, dest]
                own["Names"] = kept
            if depth < TREE_LEVELS:
                for kid in self.doc.get(own.get("Kids")) or []:
                    tree(kid, depth + 1)

        tree(self.doc.dict_of(self.doc.catalog.get("Names")).get("Dests"), 0)
        old = self.doc.dict_of(self.doc.catalog.get("Dests"))
        for key in [k for k, v in old.items() if self.hits(v)]:
            gone.add(key.encode("latin-1"))
            del old[key]
        return gone

    def outlines(self) -> int:
        """Items that lead to a page that goes lose their target; they stay as headings."""
        n, seen, todo = 0, set(), [self.doc.dict_of(self.doc.catalog.get("Outlines")).get("First")]
        while todo and len(seen) < OUTLINE_ITEMS:
            ref = todo.pop()
            if not isinstance(ref, Ref) or ref in seen:
                continue
            seen.add(ref)
            own = self.doc.dict_of(ref)
            if self.leads(own):
                own.pop("Dest", None)
                own.pop("A", None)
                n += 1
            todo += [own.get("Next"), own.get("First")]
        return n

    def links(self, page: content.Page) -> int:
        annots = self.doc.get(page.dict.get("Annots"))
        if not isinstance(annots, list):
            return 0
        kept = [a for a in annots if not self.leads(self.doc.dict_of(a))]
        n = len(annots) - len(kept)
        if n:
            page.dict["Annots"] = kept
        return n

    def form(self, dropped: set[Ref]) -> int:
        """A field goes when all its widgets are on pages that go."""
        form = self.doc.dict_of(self.doc.catalog.get("AcroForm"))
        fields = self.doc.get(form.get("Fields"))
        if not isinstance(fields, list):
            return 0
        lost = {a for p in self.leaves if p.ref in dropped for a in self.doc.get(p.dict.get("Annots")) or [] if isinstance(a, Ref)}
        seen: set[Ref] = set()
        removed = 0

        def keep(ref: Any) -> bool:
            nonlocal removed
            if not isinstance(ref, Ref) or ref in seen:
                return True
            seen.add(ref)
            own = self.doc.dict_of(ref)
            kids = self.doc.get(own.get("Kids"))
            if isinstance(kids, list) and kids:
                left = [k for k in kids if keep(k)]
                own["Kids"] = left
                stays = bool(left)
            else:
                stays = ref not in lost and own.get("P") not in dropped
            removed += not stays and "T" in own
            return stays

        form["Fields"] = [f for f in fields if keep(f)]
        return removed

    def sweep(self, dropped: set[Ref]) -> int:
        """Null what still refers to a page that goes, except from such pages themselves."""
        n, seen, todo = 0, set(), [self.doc.trailer]

        def cleared(value: Any) -> Any:
            nonlocal n
            if isinstance(value, Ref):
                if value in dropped:
                    n += 1
                    return None
                if value not in seen:
                    seen.add(value)
                    if value in self.doc.objects:
                        todo.append(value)
                return value
            if isinstance(value, Stream):
                value.dict = cleared(value.dict)
                return value
            if isinstance(value, dict):
                for k in list(value):
                    value[k] = cleared(value[k])
                return value
            return [cleared(x) for x in value] if isinstance(value, list) else value

        while todo:
            item = todo.pop()
            if isinstance(item, Ref):
                self.doc.objects[item] = cleared(self.doc.objects[item])
            else:
                cleared(item)
        return n

    def prune(self) -> int:
        return prune(self.doc)


def prune(doc: Document) -> int:
    """Drop objects that the trailer does not reach."""
    seen: set[Ref] = set()
    todo = [t for _, t in references(doc.trailer)]
    while todo:
        ref = todo.pop()
        if ref not in seen and ref in doc.objects:
            seen.add(ref)
            todo += [t for _, t in references(doc.objects[ref])]
    before = len(doc.objects)
    doc.objects = {r: v for r, v in doc.objects.items() if r in seen}
    return before - len(doc.objects)
