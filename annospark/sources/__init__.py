"""Sources and sinks: tables with ids, sharded files, viewer links, video scripts, publishing."""
