"""Plain sequential statements of the rules, to compare the Spark plans with."""

import re


def terms(question):
    return {w for w in re.split("[^a-z0-9]+", question.lower()) if len(w) >= 3}


def split(text, delimiter="\n\n"):
    return [p.strip() for p in text.split(delimiter) if p.strip()]


def select(paras, question, budget):
    """Indexes taken and bytes used."""
    ts = terms(question)
    score = [sum(t in p.lower() for t in ts) for p in paras]
    used, chosen = 0, []
    for i in sorted(range(len(paras)), key=lambda i: (-score[i], i)):
        cost = len(paras[i].encode()) + (2 if used else 0)
        if used + cost <= budget:
            chosen.append(i)
            used += cost
    return sorted(chosen), used


def pack_pool(docs, question, budget):
    """``docs``: dicts in storage order. Returns {(doc_id, idx): (decision, sent)} and gaps by reason."""
    left, out = budget, {}

    def emit(key, size, ref, image):
        nonlocal left
        if ref:
            out[key] = ("ref", 0)
        elif size == 0:
            return
        elif size <= left:
            left -= size
            out[key] = ("whole", size)
        else:
            out[key] = ("omitted_image" if image else "omitted", 0)

    for d in docs:
        t = d["text"].strip()
        if d["kind"] == "text":
            emit((d["doc_id"], -1), len(t.encode()), d.get("ref"), False)
        elif d["state"] == "ready":
            if not t:
                continue
            size = len(t.encode())
            if d.get("ref") or size <= left:
                emit((d["doc_id"], -1), size, d.get("ref"), False)
            else:
                _, used = select(split(t), question, left)
                out[(d["doc_id"], -1)] = ("partial", used) if used else ("omitted", 0)
                left -= used
            for i, data in enumerate(d.get("images", [])):
                emit((d["doc_id"], i), 4 * ((len(data) + 2) // 3), None, True)
        elif d["state"] == "":
            emit((d["doc_id"], -1), len(d["text"].encode()), d.get("ref"), False)
    return out


def pack_pages(sizes, budget, most=12):
    """(first, last, bytes, too_big) per section, pages from 1."""
    out, start, n = [], 0, len(sizes)
    while start < n:
        end, total = start, 0
        while end < n and end - start < most and total + sizes[end] <= budget:
            total += sizes[end]
            end += 1
        if end == start:
            out.append((start + 1, start + 1, sizes[start], True))
            start += 1
        else:
            out.append((start + 1, end, total, False))
            start = end
    return out


def fold_events(events):
    """Document state from events in order."""
    d = dict(state="", source="", model="", engine="", error="", size=0, at=0, text_layer=False, done=0, total=0, label="", phase="")
    for e in events:
        s = e["state"]
        if s == "pending":
            d.update(state=s, text_layer=False, done=0, total=0, label="", phase="")
        elif s == "reading":
            d.update(state=s, **{k: e[k] for k in ("text_layer", "done", "total", "label", "phase")})
        elif s == "ready":
            d.update(
                state=s, error="", size=len(e["text"].encode()),
                **{k: e[k] for k in ("source", "model", "engine", "at", "text_layer", "done", "total", "label", "phase")},
            )
        elif s == "failed":
            d.update(state=s, error=e["error"], at=e["at"], text_layer=e["text_layer"], phase="")
            if e["total"] > 0:
                d.update(done=e["done"], total=e["total"], label=e["label"])
    return d


def fold_graph(events):
    g = dict(doc=None, current=None, modified=False, source_key="", generated=0, generation="")
    for e in events:
        k = e["kind"]
        if k == "manual":
            g.update(current=e["graph"], modified=True)
        elif k == "restore":
            g.update(current=g["doc"], modified=False)
        else:
            g["generation"] = k
            if k == "ok":
                g.update(doc=e["graph"], source_key=e["source_key"], generated=e["at"])
                if not g["modified"]:
                    g["current"] = e["graph"]
    return g
