"""Raw records for curation tests: one lead line and 99 plain ones, all legal and colourless."""

import json


def item(uid, **kw):
    base = {"uid": uid, "name": uid.title(), "text": "", "cmc": 1.0, "layout": "normal", "colorIdentity": [],
            "types": ["Artifact"], "superTypes": [], "subTypes": [], "keywords": [], "legalities": {"commander": "legal"}}
    return {**base, **kw}


def line(uid, line_id, quantity=1, categories=("Artifacts",), companion=False, deleted=None, **kw):
    return {"id": line_id, "quantity": quantity, "categories": list(categories), "companion": companion,
            "deletedAt": deleted, "card": {"rarity": "rare", "prices": {"tcg": 1.5}, "oracleCard": item(uid, **kw)}}


def deck(n=99, lead=None, extra=(), cards=None, **kw):
    lead = [line("lead", 0, categories=("Commander",))] if lead is None else lead
    body = [line(f"card-{i}", i + 1) for i in range(n)] if cards is None else cards
    base = {"id": 1, "name": "Deck", "private": False, "unlisted": False, "deckFormat": 3, "edhBracket": 3,
            "viewCount": 5000, "updatedAt": "2025-01-01T00:00:00Z", "owner": {"id": 7, "username": "x"},
            "categories": [], "cards": [*lead, *body, *extra]}
    return {**base, **kw}


def record(deck_id, response, fetched="2025-02-01T00:00:00Z", status=200):
    return {"record_type": "detail", "run_id": "r", "fetched_at": fetched, "deck_id": deck_id,
            "detail_url": f"u/{deck_id}", "status": status, "response": response}


def write(path, records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) for r in records) + "\n\n")
    return str(path)
