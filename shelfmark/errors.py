"""Error classes and the exit status that each maps to."""


class CatalogError(Exception):
    status = 1


class Partial(CatalogError):
    """The run ended, but some entries failed or differ."""

    status = 1


class Usage(CatalogError):
    status = 2


class NoMatch(Usage):
    """A pattern or expression matched nothing."""


class Conflict(Usage):
    """A path is already in the catalog and the policy is ``error``."""


class Corrupt(CatalogError):
    """A constraint of the catalog doesn't hold, or content fails its digest."""

    status = 3


class Locked(CatalogError):
    """Another writer committed the expected next generation."""

    status = 4


DAMAGE = (Corrupt,)


def status(error: BaseException | None) -> int:
    return 0 if error is None else getattr(error, "status", 70)


def is_damage(error: BaseException) -> bool:
    return isinstance(error, DAMAGE)
