"""All registered queries; importing a module of queries registers them."""

from tidemark.plans import channels, evaluation, ledgers, market, models, more, outcomes, policies, routes, text  # noqa: F401
from tidemark.plans.base import QUERIES, SQL  # noqa: F401
