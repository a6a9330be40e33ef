"""End-to-end plans and the query catalogue."""

from __future__ import annotations


def all_queries():
    from flowsentry.plans import alert_views, detection, learning, stores, streams
    from flowsentry.plans.catalog import Catalog

    catalog = Catalog()
    for module in (detection, alert_views, stores, learning, streams):
        module.register(catalog)
    return catalog
