"""Question answering over tables of facts, as Spark DataFrame plans."""

from importlib import import_module

# loaded when first used, so that Python workers import only what they run
_PLACES = {
    "RetrievalConfig": "factlane.config",
    "answer": "factlane.plans.dispatch",
    "classification_qa": "factlane.plans.classify_qa",
    "compare_methods": "factlane.plans.dispatch",
    "predict_intent": "factlane.plans.classify_qa",
    "retrieval_qa": "factlane.plans.retrieval_qa",
    "rule_qa": "factlane.plans.rule_qa",
}
__all__ = sorted(_PLACES)


def __getattr__(name: str):
    if name not in _PLACES:
        raise AttributeError(name)
    return getattr(import_module(_PLACES[name]), name)
