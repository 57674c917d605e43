"""Exceptions raised on purpose. Setting mistakes are ConfigurationErrors and come before anything is read."""


from typing import Optional


class CorploomError(Exception):
    """Anything this library raises on purpose."""


class ConfigurationError(CorploomError):
    """A wrong argument."""


class MissingDependencyError(CorploomError):
    """An optional package is needed and absent."""


class SourceNotFoundError(ConfigurationError):
    """The path to read is not there."""


class UnsupportedFormatError(ConfigurationError):
    """No registered format has that name or file extension."""


class DuplicateSourceError(ConfigurationError):
    """Sources read together share names, so their document ids would collide."""


class InvalidDocumentError(CorploomError):
    """A document field has a wrong type or value."""


class StreamConsumedError(CorploomError):
    """A source that can be read once was read again."""


class RevisionResolutionError(CorploomError):
    """A dataset hub cannot name the exact revision."""


class IncompletePassError(CorploomError):
    """Results of a pass were asked for before one was complete."""


class UnreachableMixError(CorploomError):
    """The languages at hand cannot give the wanted mix."""


class CorpusExistsError(CorploomError):
    """The place to save to is taken, and overwriting was not asked for."""


class UnsafeDestinationError(CorploomError):
    """A save would destroy its own input, or files that are no saved corpus."""


class MetadataNotSerializableError(CorploomError):
    """Metadata that JSON cannot hold."""


class IntegrityError(CorploomError):
    """A saved corpus disagrees with its hashes or its fingerprint."""


class ManifestError(CorploomError):
    """A manifest is missing or malformed."""


class UnsupportedManifestVersionError(ManifestError):
    """A manifest of a format version that this library does not read."""


class ReadError(CorploomError):
    """One bad row, or one bad file or source."""

    def __init__(self, source: str, message: str, position: Optional[int] = None, level: str = "row") -> None:
        self.source, self.message, self.position, self.level = source, message, position, level
        super().__init__(f"{source if position is None else f'{source}#{position}'}: {message}")


class MissingTextFieldError(ReadError):
    """A source whose first row, or whose schema, lacks the text field."""

    def __init__(self, where: str, what: str) -> None:
        super().__init__(where, what, level="file")
