"""Sources and sinks: driver tables and the reference's file formats."""
