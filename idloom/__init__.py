"""Document identity and entity resolution as Spark expressions and plans.

The names below are what most users need; they are loaded when they are first asked for. Modules have the rest.
"""

from __future__ import annotations

from importlib import import_module

_EXPORTS = {
    "functions.normalize": "tax_number is_tax_number amount iso_date document_number plain_text account_number",
    "functions.hashing": "hamming similarity looks_same bands content_hash",
    "functions.entities": "entities payment_trace money_tokens money_overlap",
    "operators.ids": "document_id invoice receipt contract bank_statement correction bill cash debit_note delivery_note expense_report generic parse verify local_fallback TYPES",
    "operators.compare": "file_identity parse_file_identity verify_file_identity compare_files canonical_diff",
    "operators.matching": "find_duplicates evaluate blocked_pairs match_reason completeness",
    "operators.reconcile": "reconcile supersessions",
    "operators.fusion": "merge_records",
    "operators.nearest": "best_match rank_against",
    "operators.components": "components",
    "operators.classify": "classify extract extract_all",
    "plans.pipeline": "process process_batch prior_duplicates determinism record",
    "sources.files": "scan read_texts file_ids generic_features write_json as_json",
    "sources.images": "fingerprints image_features read_images",
    "sources.universal": "file_features verify_files",
    "sources.ocr": "recognise",
    "sqlfunctions": "register",
}
_HOME = {name: module for module, names in _EXPORTS.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str) -> object:
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f"{__name__}.{_HOME[name]}"), name)
