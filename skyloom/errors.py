"""Errors that the library raises."""


class SkyloomError(Exception):
    """Base of all errors here."""


class TemplateError(SkyloomError):
    """A template doesn't describe the file it is used with."""


class UnitError(SkyloomError):
    """A unit is unknown, or of another dimension."""


class MissingError(SkyloomError):
    """A station, sensor, model series or column that was asked for is not there."""


class AmbiguousError(SkyloomError):
    """More than one thing matches where one was asked for."""


class ArgumentError(SkyloomError):
    """An argument has a value that the operation can't use."""


class SettingsError(SkyloomError):
    """An unknown setting."""
