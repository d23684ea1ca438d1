"""Errors that callers can test by name."""


class ArchiveError(ValueError):
    """An archive, or what is asked of it, is not valid."""


class HeaderTooSmall(ArchiveError): ...


class HeaderTooLarge(ArchiveError): ...


class InvalidHeaderLength(ArchiveError): ...


class InvalidHeader(ArchiveError): ...


class UnexpectedEOF(ArchiveError): ...


class InvalidOffset(ArchiveError): ...


class TensorInvalidInfo(ArchiveError): ...


class MetadataIncompleteBuffer(ArchiveError): ...


class DuplicateTensor(ArchiveError): ...


class UnknownTensor(ArchiveError): ...


class UnknownDType(ArchiveError): ...


class DimMismatch(ArchiveError): ...


class ShapeMismatch(ArchiveError): ...


class UnequalTensors(ArchiveError): ...


class EnlargingCast(ArchiveError): ...


class OddPackedExtent(ArchiveError): ...


class ReleasedTensor(ArchiveError): ...


class UnknownSource(KeyError): ...


class InvalidConfig(ValueError): ...


class NoWorkspace(RuntimeError): ...
