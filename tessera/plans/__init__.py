"""Query plans over the fixture tables; importing this package registers all
of them in :mod:`tessera.plans.registry`."""

from tessera.plans import (  # noqa: F401
    auction_plan,
    features_plan,
    graph_plan,
    models_plan,
    retrieval_plan,
    sources_plan,
    stats_plan,
    tabular,
)  # noqa: F401
