"""Sources and sinks: FASTQ files and sample sheets."""
