"""What can be wrong with a file."""


class SstError(ValueError):
    """A table file cannot be read or written."""


class SstFormatError(SstError):
    """Bytes do not follow the format."""


class SstChecksumError(SstError):
    """Bytes do not match their checksum."""


class SstUnsupportedError(SstError):
    """The file uses a feature that is not supported."""
