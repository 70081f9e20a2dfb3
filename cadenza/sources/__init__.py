"""Where rows come from: sample tables, WAV files, event tables, embedding providers."""
