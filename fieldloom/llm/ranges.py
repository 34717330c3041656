"""Places and running sums within groups, as the rest of the library has them."""

from fieldloom.operators.ranges import AIM, numbered

__all__ = ["AIM", "numbered"]
