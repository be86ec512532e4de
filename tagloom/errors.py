"""What can go wrong in a run."""


class DemuxError(Exception):
    """Any error that a run reports to its user."""


class ConfigError(DemuxError):
    """An option is out of bounds or contradicts another."""


class SampleSheetError(DemuxError):
    """The sample sheet can't be used."""


class FastqError(DemuxError):
    """A FASTQ file is malformed."""


class PairError(DemuxError):
    """Mates don't belong together."""


class OutputError(DemuxError):
    """Planned outputs collide, exist, or would overwrite an input."""
