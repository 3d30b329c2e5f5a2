"""What a comparison is, before any data is read: types, schemas, options and the resolved plan."""
