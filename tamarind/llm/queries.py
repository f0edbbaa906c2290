"""Query catalogue of the subpackage."""

from __future__ import annotations

from tamarind.llm import components, gazetteer, language, leakage, lookalike, packing, personal, residue

QUERIES = {
    "p1_found": gazetteer.p1_found,
    "p2_found": personal.p2_found,
    "p3_found": lookalike.p3_found,
    "p3_classes": lookalike.p3_classes,
    "p4_found": language.p4_found,
    "p5_found": components.p5_found,
    "p8_packed": packing.p8_packed,
    "p8_fill": packing.p8_fill,
    "p8_pieces": packing.p8_pieces,
    "p9_found": leakage.p9_found,
    "p10_found": residue.p10_found,
}
ORACLES: dict[str, str] = {**components.ORACLES, **packing.ORACLES}
